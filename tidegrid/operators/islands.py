"""Gaps and islands: runs of rows told apart by a condition, by inactivity or by touching ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def island_ids(rows: DataFrame, keys: list[str], order: str, new: Column, name: str = "island") -> DataFrame:
    """Numbers the runs of each key: a run begins at its first row and wherever `new` holds."""
    w = W.partitionBy(*keys).orderBy(order)
    first = F.lag(F.lit(1)).over(w).isNull()
    return rows.withColumn("_new", (first | F.coalesce(new, F.lit(False))).cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def runs_where(rows: DataFrame, keys: list[str], order: str, condition: Column) -> DataFrame:
    """Maximal runs of adjacent rows where the condition holds: keys, start, end, n."""
    w = W.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_c", F.coalesce(condition, F.lit(False)))
    ids = island_ids(marked, keys, order, F.col("_c") != F.lag("_c").over(w))
    return ids.where("_c").groupBy(*keys, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n")).drop("island")


def longest_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The longest run of each key, of several the first."""
    best = F.max_by(F.struct("start", "end", "n"), F.struct("n", -F.unix_micros(F.col("start").cast("timestamp"))))
    return runs.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def first_run(runs: DataFrame, keys: list[str], at_least: int) -> DataFrame:
    """Start of each key's first run of so many rows."""
    return runs.where(F.col("n") >= at_least).groupBy(*keys).agg(F.min("start").alias("onset"))


def gaps(rows: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """Ranges [start, end) without rows between a key's rows that are more than a step apart: n missing steps."""
    w = W.partitionBy(*keys).orderBy(time)
    step = F.expr(f"interval {seconds} seconds")
    after = rows.select(*keys, F.col(time).alias("_t"), F.lead(time).over(w).alias("end"))
    out = after.where(F.col("end") > F.col("_t") + step).withColumn("start", F.col("_t") + step)
    return out.select(*keys, "start", "end", missing("start", "end", seconds).alias("n"))


def missing(start: str, end: str, seconds: int = 60) -> Column:
    return F.floor(F.timestamp_diff("SECOND", F.col(start), F.col(end)) / seconds).cast("long")


def all_gaps(rows: DataFrame, keys: list[str], time: str, seconds: int, since: Column, until: Column) -> DataFrame:
    """gaps() plus what is missing after `since` before a key's first row and before `until` after its last."""
    step = F.expr(f"interval {seconds} seconds")
    span = rows.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    lead = span.select(*keys, since.alias("start"), F.col("_a").alias("end"))
    trail = span.select(*keys, (F.col("_b") + step).alias("start"), until.alias("end"))
    edge = lead.unionByName(trail).where("start < end")
    return gaps(rows, keys, time, seconds).unionByName(edge.withColumn("n", missing("start", "end", seconds)))


def join_ranges(ranges: DataFrame, keys: list[str], within_seconds: int) -> DataFrame:
    """Ranges start, end of each key, those less than `within` apart put together; overlapping and nested ones too."""
    w = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col("start") >= F.col("_reach") + F.expr(f"interval {within_seconds} seconds")
    ids = island_ids(ranges.withColumn("_reach", reach).withColumn("_o", F.row_number().over(w)), keys, "_o", apart)
    return ids.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def day_runs(days: DataFrame, keys: list[str], day: str) -> DataFrame:
    """Runs of consecutive dates: start, end, n. Repeated dates count once."""
    w = W.partitionBy(*keys).orderBy(day)
    ids = days.select(*keys, day).distinct().withColumn("_g", F.date_sub(F.col(day), F.row_number().over(w)))
    return ids.groupBy(*keys, "_g").agg(F.min(day).alias("start"), F.max(day).alias("end"), F.count("*").alias("n")).drop("_g")


def clipped(runs: DataFrame, since: Column) -> DataFrame:
    return runs.where(F.col("end") >= since).withColumn("start", F.greatest("start", since))


def clusters(rows: DataFrame, keys: list[str], time: str, seconds: int) -> DataFrame:
    """rows with an island number: a row more than so many seconds after the one before begins another."""
    w = W.partitionBy(*keys).orderBy(time)
    return island_ids(rows, keys, time, F.col(time) > F.lag(time).over(w) + F.expr(f"interval {seconds} seconds"), "cluster")
