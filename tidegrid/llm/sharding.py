"""Sharding by size-tiered compaction under a versioned manifest."""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path

#: Bytes of a finished shard's file, and how many shards of one tier make a run worth merging.
TARGET_BYTES = 128 << 20
FANOUT = 4
#: Shards below this size are all of the lowest tier.
LEAST_BYTES = 1 << 20
#: Source shards of one merge job, whose names go to every task.
WAVE = 10_000


@dataclass(frozen=True)
class Shard:
    """One immutable Parquet file: its name under the store's root, what it holds, and how often its rows were merged."""

    name: str
    rows: int
    bytes: int
    merges: int


def tier(size: int, least: int = LEAST_BYTES, fanout: int = FANOUT) -> int:
    """0 for sizes below least times fanout, and one more for each factor of fanout."""
    return max(0, int(math.log(max(size, 1) / least, fanout))) if size >= least else 0


def plan(shards: list[Shard], target: int = TARGET_BYTES, fanout: int = FANOUT, least: int = LEAST_BYTES) -> list[list[Shard]]:
    """Groups of shards to be merged into one file each; it looks at names and sizes only.

    While a tier holds at least fanout runs, the runs of that tier are put together, oldest first, up to the target size.
    A merged run counts with its sum in the tiers above, so chains of merges become one rewrite. Shards of three
    quarters of the target or more are finished and stay. The rest that fill no run wait for later arrivals.
    """
    runs = [([s], s.bytes) for s in shards if s.bytes * 4 < target * 3]
    while True:
        tiers: dict[int, list[tuple[list[Shard], int]]] = {}
        for run in runs:
            if run[1] * 4 < target * 3:
                tiers.setdefault(tier(run[1], least, fanout), []).append(run)
        ready = next((t for t in sorted(tiers) if len(tiers[t]) >= fanout), None)
        if ready is None:
            break
        merged, open_, size = [], [], 0
        for group, n in tiers[ready]:
            if open_ and size + n > target:
                merged.append((open_, size))
                open_, size = [], 0
            open_, size = open_ + group, size + n
        merged.append((open_, size))
        if len(merged) == len(tiers[ready]):  # none of them fit together
            break
        taken = {id(r) for r in tiers[ready]}
        runs = [r for r in runs if id(r) not in taken] + merged
    return [group for group, _ in runs if len(group) > 1]


class ShardStore:
    """Rows in immutable shards. A manifest lists the shards of each version; readers see one version, whole.

    A version is committed by renaming a finished file to its final name, which must not exist yet: of two writers one
    fails and nothing of it shows, on stores whose rename is atomic (HDFS and local folders; on others writers need a lock).
    Files that no manifest names, left by a lost driver, are never read.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # Hadoop's file layer, so that any store that Spark can write to will do.
    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, folder = self._fs(), self._path("manifest")
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read_manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """Version and shards; version 0 is the empty store."""
        have = self.versions()
        version = (have[-1] if have else 0) if version is None else version
        if version == 0:
            return 0, []
        stream = self._fs().open(self._path(f"manifest/v{version:09d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Shard(**x) for x in json.loads(text)["shards"]]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Makes shards the version after base, or raises if that version is there already."""
        jvm, version = self.spark.sparkContext._jvm, base + 1
        draft = self._path(f"manifest/.draft-{uuid.uuid4().hex}")
        out = self._fs().create(draft, False)
        try:
            out.write(bytearray(json.dumps({"version": version, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        context.rename(draft, self._path(f"manifest/v{version:09d}.json"), none)
        return version

    def _files(self, folder: str, merges: int) -> list[Shard]:
        """The files of a folder that hold rows. One small row a file comes to the driver, as into any manifest."""
        df = self.spark.read.parquet(f"{self.root}/{folder}")
        meta = df.metadataColumn("_metadata")
        found = df.groupBy(meta["file_name"].alias("f"), meta["file_size"].alias("s")).count().orderBy("f").collect()
        return [Shard(f"{folder}/{r.f}", r["count"], r.s, merges) for r in found]

    def append(self, df: DataFrame) -> int:
        """Adds the rows as they lie, each task's as one small shard, and commits a version. Nothing is shuffled."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        version, shards = self.read_manifest()
        return self.commit(version, shards + self._files(folder, 0))

    def compact(self, target: int = TARGET_BYTES, fanout: int = FANOUT, least: int = LEAST_BYTES) -> int:
        """Merges runs of similar size, each into one file, and commits a version for each wave of merges; the version it ends at."""
        groups = plan(self.read_manifest()[1], target, fanout, least)
        while groups:
            n = 1
            while n < len(groups) and sum(map(len, groups[: n + 1])) <= WAVE:
                n += 1
            self._merge(groups[:n])
            groups = groups[n:]
        return self.read_manifest()[0]

    def _merge(self, groups: list[list[Shard]]) -> int:
        """Rewrites each group as one file and commits. Rows move once, each group's to the task that writes it."""
        version, shards = self.read_manifest()
        place = self.spark.createDataFrame([(s.name, g) for g, group in enumerate(groups) for s in group], "_name string, _group int")
        # At most WAVE names, or those of one group.
        df = self.read_shards([s for group in groups for s in group], "_name").join(F.broadcast(place), "_name").drop("_name")
        folder = f"data/{uuid.uuid4().hex}"
        df.repartitionById(len(groups), F.col("_group")).drop("_group").write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(f"{self.root}/{folder}")
        gone = {s.name for group in groups for s in group}
        merged = self._files(folder, 1 + max(s.merges for group in groups for s in group))
        return self.commit(version, [s for s in shards if s.name not in gone] + merged)

    def vacuum(self, since: int = 1) -> None:
        """Deletes the versions from since on but the last, and the files that only they name. Whoever still reads one of them fails,
        so since should lie after all versions that others may read."""
        versions = self.versions()
        gone = [v for v in versions[:-1] if v >= since]
        live = {s.name for v in versions if v not in gone for s in self.read_manifest(v)[1]}
        names = {s.name for v in gone for s in self.read_manifest(v)[1]} - live
        for name in sorted(names):
            drop_path(self.spark, f"{self.root}/{name}")
        for v in gone:
            drop_path(self.spark, f"{self.root}/manifest/v{v:09d}.json")

    def read_shards(self, shards: list[Shard], name_col: str) -> DataFrame:
        df = self.spark.read.parquet(*[f"{self.root}/{s.name}" for s in shards])
        path = df.metadataColumn("_metadata")["file_path"]
        return df.withColumn(name_col, F.concat(F.lit("data/"), F.substring_index(path, "/", -2)))

    def read(self, name_col: str = "shard", version: int | None = None) -> DataFrame | None:
        """The rows of one version and each one's shard; None for the empty store."""
        shards = self.read_manifest(version)[1]
        return self.read_shards(shards, name_col) if shards else None


def shard(docs: DataFrame, root: str, arrivals: tuple[float, ...] = (0.5, 0.25, 0.25), target: int = TARGET_BYTES, fanout: int = FANOUT, least: int = LEAST_BYTES, id_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """docs with the shard that each row ends up in, its column named shard_col (in place of one docs may have).

    docs come in as many arrivals as shares are named, told apart by a hash of the id; every arrival is appended, and then
    what is due is compacted. Versions that this made on the way are deleted, older ones stay. Every row is in one shard of the last version, nulls, repeated and empty rows too; an empty
    table makes an empty store.
    """
    store, spark = ShardStore(docs.sparkSession, root), docs.sparkSession
    docs = docs.drop(shard_col)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("arrival")), F.lit(1 << 20)) / float(1 << 20)
    start, before = 0.0, store.read_manifest()[0]
    for k, share in enumerate(arrivals):
        end = 2.0 if k == len(arrivals) - 1 else start + share
        store.append(docs.where((draw >= start) & (draw < end)))
        store.compact(target, fanout, least)
        store.vacuum(before + 1)
        start = end
    out = store.read(shard_col)
    return spark.createDataFrame([], docs.withColumn(shard_col, F.lit("")).schema) if out is None else out
