"""Shared plumbing: scratch tables, stable row keys and packed exchanges."""

from __future__ import annotations

import gc
import math
import shutil
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset and all runs in one process (tests), one temporary
    folder; on a cluster, whose machines would each have a folder of their own, an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    if "dir" not in _LOCAL:
        import atexit

        _LOCAL["dir"] = tempfile.mkdtemp(prefix="tidegrid-")
        atexit.register(shutil.rmtree, _LOCAL["dir"], True)
    return "file://" + _LOCAL["dir"]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def by_merge(df: DataFrame) -> DataFrame:
    """The rows, never to be broadcast by a join. Spark guesses a scratch table's size from its compressed files and doesn't
    count what explode adds, so it would send millions of rows through the driver's memory for a few MB."""
    return df.hint("merge")


def dealt(df: DataFrame, col: str, n: int, name: str) -> DataFrame:
    """The rows as a bucketed table in the shared folder: they cross the network once, and whatever groups by col reads
    its n buckets as they lie."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, col).write.bucketBy(n, col).option("compression", "zstd").option("path", scratch_path(spark, name)).saveAsTable(table)
    return spark.table(table)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that written() made and that nothing will read any more."""
    for df in tables:
        drop_path(df.sparkSession, df.scratch)
    if tables:
        shuffles_released(tables[0].sparkSession)


def shuffles_released(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a job that is done once the driver's garbage, which still names them, is collected.

    Python's references go first, then what they held in the JVM, then what that held.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through Spark's own file system layer."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def modest_batches(spark: SparkSession) -> None:
    """Sends rows to Python 1,000 at a time where a session would send more: they hold whole texts, and a batch of them
    is held several times over by both sides. The setting stays, since results are computed after the operator returns."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= 1000:
        spark.conf.set(key, "1000")


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def layout(size: int) -> tuple[int, int]:
    """Into how many parts texts of so many bytes are dealt, and into how many buckets their keys.

    A part holds 4 MB, growing to 64 MB with the root of the size, so that the packets between parts and buckets stay
    about a thousandth of the bytes in number; a bucket has the keys of four parts' worth.
    """
    part = min(64 << 20, max(4 << 20, int(math.sqrt(1024 * size))))
    return max(1, -(-size // part)), max(1, -(-size // (4 * part)))


def with_row_key(df: DataFrame, file_col: str = "_rk_file", row_col: str = "_rk_row") -> DataFrame:
    """Adds two long columns that name each row for good, repeated rows included.

    They come from the file and the row's place in it, so every evaluation and every retry gives the same keys.
    Rows that don't come straight from files are written to the shared folder first.
    """

    def keyed(x: DataFrame) -> DataFrame:
        meta = x.metadataColumn("_metadata")
        return x.select("*", F.xxhash64(meta["file_path"]).alias(file_col), meta["row_index"].alias(row_col))

    if _straight_from_files(df):
        try:
            out = keyed(df)
            out.schema  # noqa: B018  analysis happens here
            return out
        except AnalysisException:
            pass
    return keyed(written(df, "rows"))


def _straight_from_files(df: DataFrame) -> bool:
    """Whether every row is one row of a file: the plan is a scan under filters and projections, without joins or the like."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.children().size() == 1:
        if plan.nodeName() not in ("Project", "Filter", "SubqueryAlias"):
            return False
        plan = plan.children().head()
    return plan.children().isEmpty() and plan.nodeName().startswith("Relation") or plan.nodeName() == "LogicalRelation"


def part_of(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted uint64 values as differences of the fewest whole bytes each."""
    if not len(values):
        return b""
    gaps = np.empty(len(values), np.uint64)
    gaps[0] = values[0]
    np.subtract(values[1:], values[:-1], out=gaps[1:])
    width = 1 if len(gaps) < 2 else max(1, (int(gaps[1:].max()).bit_length() + 7) // 8)
    return bytes([width]) + int(gaps[0]).to_bytes(8, "little") + gaps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    width = data[0]
    gaps = np.zeros((n, 8), np.uint8)
    gaps[1:, :width] = np.frombuffer(data, np.uint8, (n - 1) * width, 9).reshape(n - 1, width)
    out = gaps.view(np.uint64).ravel()
    out[0] = int.from_bytes(data[1:9], "little")
    return np.cumsum(out, dtype=np.uint64)


#: A packed request or answer: the part it belongs to, the bucket of its keys, the level, how many keys, and bytes.
PACKET = "part int, bucket int, level int, n long, data binary, extra binary"
_PACKET_ARROW = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("level", pa.int32()), ("n", pa.int64()), ("data", pa.binary()), ("extra", pa.binary())])


def packets(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.table([pa.array(c, f.type) for c, f in zip(cols, _PACKET_ARROW, strict=True)], schema=_PACKET_ARROW)


def by_bucket(keys: np.ndarray, n_buckets: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each bucket in sorted keys of so many bits: bucket b holds the b-th of n_buckets equal ranges."""
    step = (1 << bits) // n_buckets
    edges = np.array([b * step for b in range(1, n_buckets)], np.uint64)
    at = np.searchsorted(keys, edges)
    return np.concatenate([[0], at]), np.concatenate([at, [len(keys)]])


def packed_requests(part: int, level: int, keys: np.ndarray, n_buckets: int, extra: np.ndarray | None = None, bits: int = 64) -> list[tuple]:
    """Packets for sorted keys; extra has one fixed-width row a key."""
    lo, hi = by_bucket(keys, n_buckets, bits)
    return [(part, b, level, int(h - l), pack_sorted(keys[l:h]), None if extra is None else extra[l:h].tobytes()) for b, (l, h) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)) if h > l]
