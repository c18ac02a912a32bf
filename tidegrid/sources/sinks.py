"""Keyed tables on plain files: insert if absent, upsert, run log, lock; and report files."""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Iterator
from datetime import UTC, date, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import inserted_if_absent, upserted


class LockedError(RuntimeError):
    """Another writer is at work."""


class KeyedStore:
    """A Parquet table with unique keys. Each write makes a new version in a folder of its own and then moves a pointer to it,
    so readers see all of a write or none, and a writer that dies leaves the table as it was.

    partition: a column that the table is laid out by; an upsert rewrites only the partitions that new rows fall into, and the
    others are taken over by name.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: T.StructType, stamp: str | None = None, partition: str | None = None) -> None:
        self.spark, self.path, self.keys, self.schema, self.stamp, self.partition = spark, path.rstrip("/"), keys, schema, stamp, partition

    # ---- files ----

    def _hadoop(self, name: str = ""):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        p, fs = self._hadoop(name)
        if not fs.exists(p):
            return None
        s = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8")
        finally:
            s.close()

    def _write(self, name: str, text: str, overwrite: bool) -> None:
        p, fs = self._hadoop(name)
        out = fs.create(p, overwrite)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def state(self) -> dict:
        """The newest version: number, folders by partition value, and columns."""
        p, fs = self._hadoop("versions")
        if not fs.exists(p):
            return {"version": 0, "folders": {}, "columns": self.schema.names}
        newest = max(x.getPath().getName() for x in fs.listStatus(p) if x.getPath().getName().endswith(".json"))
        return json.loads(self._read(f"versions/{newest}"))

    def _commit(self, state: dict) -> None:
        draft, name = f"versions/.{uuid.uuid4().hex}", f"versions/{state['version']:09d}.json"
        self._write(draft, json.dumps(state), False)
        src, _ = self._hadoop(draft)
        dst, _ = self._hadoop(name)
        jvm = self.spark.sparkContext._jvm
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        # Fails if another writer has made this version.
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(src.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(src, dst, none)

    # ---- reads ----

    def read(self, values: list[str] | None = None) -> DataFrame:
        """The table, or only the partitions of some values."""
        folders = self.state()["folders"]
        paths = [f"{self.path}/{f}" for v, f in sorted(folders.items()) if values is None or v in values]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def watermarks(self, key: str, time: str) -> dict[str, datetime]:
        """Latest time of each key; a table has few of these keys."""
        return {r[0]: r[1] for r in self.read().groupBy(key).agg(F.max(time)).collect()}

    # ---- writes ----

    def migrate(self, schema: T.StructType) -> list[str]:
        """Takes a schema with more columns; old rows have nulls there. The names added."""
        added = [f.name for f in schema if f.name not in self.schema.names]
        lost = [n for n in self.schema.names if n not in schema.names]
        if lost:
            raise ValueError(f"columns can't go: {lost}")
        self.schema = T.StructType([schema[f.name] if f.name in self.schema.names else T.StructField(f.name, f.dataType, True) for f in schema])
        return added

    def _put(self, df: DataFrame, state: dict, values: list[str]) -> None:
        version, folders = state["version"] + 1, dict(state["folders"])
        for v in values:
            folder = f"data/{version:09d}-{uuid.uuid4().hex[:8]}-{len(folders)}"
            part = df if self.partition is None else df.where(F.col(self.partition).cast("string") == v)
            part.select(*self.schema.names).write.parquet(f"{self.path}/{folder}")
            folders[v] = folder
        self._commit({"version": version, "folders": folders, "columns": self.schema.names})

    def _values(self, df: DataFrame) -> list[str]:
        return [""] if self.partition is None else [r[0] for r in df.select(F.col(self.partition).cast("string")).distinct().collect()]

    def upsert(self, new: DataFrame) -> int:
        """Puts in the rows of new, each in the place of one with its keys. Returns how many."""
        if self.stamp:
            new = new.withColumn(self.stamp, F.current_timestamp())
        new = new.select(*[F.col(f.name).cast(f.dataType) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]).toDF(*self.schema.names)
        state, n = self.state(), new.count()
        values = self._values(new)
        if n:
            self._put(upserted(self.read(values), new, self.keys), state, values)
        return n

    def insert_if_absent(self, new: DataFrame, order: list[str]) -> int:
        """Appends rows whose key isn't there yet, of several in new the first. Returns how many."""
        state = self.state()
        values = self._values(new)
        old = self.read(values)
        fresh = inserted_if_absent(old, new.select(*self.schema.names), self.keys, order)
        n = fresh.count()
        if n:
            self._put(old.unionByName(fresh), state, values)
        return n

    def rewrite(self, change) -> None:
        """Replaces the whole table by change(table), in one version."""
        self._put(change(self.read()), self.state() | {"folders": {}}, self._values(change(self.read())))

    # ---- runs and locks ----

    @contextlib.contextmanager
    def lock(self, name: str) -> Iterator[None]:
        """One writer at a time: a file that only one can create. Raises LockedError if it is there."""
        from py4j.protocol import Py4JJavaError

        try:
            self._write(f"locks/{name}", datetime.now(UTC).isoformat(), False)
        except Py4JJavaError as e:
            raise LockedError(name) from e
        try:
            yield
        finally:
            p, fs = self._hadoop(f"locks/{name}")
            fs.delete(p, False)

    def start_run(self, mode: str, write_from: datetime | None) -> str:
        run = uuid.uuid4().hex
        self._write(f"runs/{run}-start.json", dumps({"run": run, "mode": mode, "write_from": write_from, "started": datetime.now(UTC), "status": "running"}), False)
        return run

    def finish_run(self, run: str, status: str, rows: int | None, details: str | None) -> None:
        self._write(f"runs/{run}-finish.json", dumps({"run": run, "finished": datetime.now(UTC), "status": status, "rows": rows, "details": (details or "")[:2000] or None}), False)

    def runs(self) -> DataFrame:
        """The run log: each run with how it ended, if it did."""
        schema = "run string, mode string, write_from string, started string, finished string, status string, rows long, details string"
        p, fs = self._hadoop("runs")
        if not fs.exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.path}/runs").groupBy("run").agg(F.max("mode").alias("mode"), F.max("started").alias("started"), F.max("finished").alias("finished"), F.coalesce(F.max(F.when(F.col("finished").isNotNull(), F.col("status"))), F.lit("running")).alias("status"), F.max("rows").alias("rows"), F.max("details").alias("details"))


def retag(articles: KeyedStore, scores: KeyedStore, changed: DataFrame) -> None:
    """Gives articles new tags and takes away the scores that went with the old; each table changes in one version, scores
    first, so that after a failure in between the articles are found to need it again. changed: url, time, new_tags."""
    c = changed.select("url", "time", "new_tags")
    scores.rewrite(lambda s: s.join(c.select("url", "time"), ["url", "time"], "left_anti"))
    articles.rewrite(lambda a: a.join(c, ["url", "time"], "left").withColumn("coin_tags", F.coalesce("new_tags", "coin_tags")).drop("new_tags"))


def dumps(value: Any) -> str:
    """JSON of what reports hold: times in ISO form, numbers of numpy as numbers, what isn't a number as null."""

    def plain(x: Any) -> Any:
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple, set)):
            return [plain(v) for v in x]
        if isinstance(x, (datetime, date)):
            return x.isoformat()
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
            return None
        return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)

    return json.dumps(plain(value))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def export_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        write_csv(df, f"{path}/{name}")


def sample(df: DataFrame, n: int) -> DataFrame:
    """The n rows that come first by the first column, largest first."""
    return df.orderBy(F.desc(df.columns[0])).limit(n)


def write_report(spark: SparkSession, tables: dict[str, DataFrame], summary: dict, path: str) -> None:
    """Tables as CSV and a one-object summary as JSON, under one path."""
    export_tables(tables, path)
    KeyedStore(spark, path, [], T.StructType([]))._write("summary.json", dumps(summary), True)


def to_kafka(messages: DataFrame, servers: str, topic: str, checkpoint: str | None = None, **options: str):
    """key and value to a topic, acknowledged by all replicas, five retries; a stream if messages are one. Needs Spark's Kafka connector."""
    opts = {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "5"} | options
    if messages.isStreaming:
        return messages.writeStream.format("kafka").options(**opts).option("checkpointLocation", checkpoint).start()
    return messages.write.format("kafka").options(**opts).save()
