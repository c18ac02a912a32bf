"""Joins that Spark has no single operator for, and the forms of update that a keyed table needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], chunk_seconds: int | None = None) -> DataFrame:
    """left with the values of each key's last right row at or before left_time; null if there is none.

    Both sides are stacked and the last right row is carried forward, so there is one shuffle by key and no join of ranges.
    chunk_seconds: cuts each key's time line into chunks, so that one key's rows spread over tasks; the last right row of
    each chunk is then carried to the chunks after it.
    """
    row = F.struct(F.col(right_time).alias("_rt"), *values)
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), row.alias("_v"), F.lit(None).cast(left.select(F.struct("*").alias("l")).schema["l"].dataType).alias("_l"))
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(row.alias("v")).schema["v"].dataType).alias("_v"), F.struct("*").alias("_l"))
    both = r.unionByName(l)
    if chunk_seconds is None:
        w = W.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
        got = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w))
    else:
        both = both.withColumn("_c", F.window("_t", f"{chunk_seconds} seconds")["start"])
        ends = both.where("_side = 0").groupBy(*keys, "_c").agg(F.max_by("_v", "_t").alias("_e"))
        some = both.select(*keys, "_c").distinct().join(ends, [*keys, "_c"], "left")
        before = some.withColumn("_before", F.last("_e", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_c").rowsBetween(W.unboundedPreceding, -1))).drop("_e")
        w = W.partitionBy(*keys, "_c").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
        got = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).join(before, [*keys, "_c"]).withColumn("_v", F.coalesce("_v", "_before"))
    return got.where("_side = 1").select("_l.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def with_flag(left: DataFrame, right: DataFrame, keys: list[str], name: str) -> DataFrame:
    """left and whether right has a row of the same keys; rows of left are neither lost nor repeated."""
    return left.join(right.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def not_in(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


def days_below(rows: DataFrame, days: DataFrame, key: str, day: str, time: str, tags: str, at_least: int) -> DataFrame:
    """Days of each wanted key on which fewer rows than at_least carry the key as a tag: key, day, n.

    days: the wanted keys and days. The range condition (a day's start to the next) is an equality of dates.
    """
    counts = rows.select(F.explode(tags).alias(key), F.to_date(time).alias(day)).groupBy(key, day).agg(F.count("*").alias("n"))
    return days.join(counts, [key, day], "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < at_least)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in, or in the place of rows of the same keys. new must have a key once."""
    return not_in(old, new, keys).unionByName(new, allowMissingColumns=True)


def inserted_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows to append: those of new whose key old doesn't have, of several of a key the first."""
    first = new.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return not_in(first, old, keys)


def last_wins(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(sequence)))).where("_n = 1").drop("_n")


def merged_arrays(old: DataFrame, new: DataFrame, keys: list[str], array: str) -> DataFrame:
    """Keys of either side with the distinct elements of both arrays, sorted."""
    o, n = old.select(*keys, F.col(array).alias("_o")), new.select(*keys, F.col(array).alias("_n"))
    empty = F.array().cast(old.schema[array].dataType)
    return o.join(n, keys, "full_outer").select(*keys, F.array_sort(F.array_union(F.coalesce("_o", empty), F.coalesce("_n", empty))).alias(array))


def differ(a: Column, b: Column) -> Column:
    """Whether two arrays differ as sets; null is empty."""
    clean = lambda x: F.array_sort(F.array_distinct(F.coalesce(x, F.array().cast("array<string>"))))
    return clean(a) != clean(b)


def changed_since(bars: DataFrame, computed: DataFrame, keys: list[str], changed: str, at: str) -> DataFrame:
    """Bars that computed lacks, or has from before they changed."""
    return bars.join(computed.select(*keys, at), keys, "left").where(F.col(at).isNull() | (F.col(changed) > F.col(at)))


def wide_by(rows: DataFrame, key: str, names: dict[str, str], on: str, values: dict[str, str]) -> DataFrame:
    """One row for each `on`, with columns <name>_<suffix> of every named key that has it: a full outer join of the keys'
    rows, written as one aggregation and so with one shuffle."""
    picks = [F.max(F.when(F.col(key) == k, F.col(v))).alias(f"{n}_{s}") for k, n in names.items() for v, s in values.items()]
    return rows.where(F.col(key).isin(list(names))).groupBy(on).agg(*picks)


def missing_pairs(times: DataFrame, time: str, wanted: list[str], key: str, have: DataFrame) -> DataFrame:
    """Times at which any wanted key has no row in have. The wanted keys are an array in the plan, not a join."""
    pairs = times.select(time).distinct().select(time, F.explode(F.array(*[F.lit(w) for w in wanted])).alias(key))
    return not_in(pairs, have, [time, key]).select(time).distinct()


def offset_pairs(rows: DataFrame, keys: list[str], order: str, value: str, horizon: int) -> DataFrame:
    """Each row with the value h rows further on, for h from 1 to horizon, as an array from one frame instead of as many joins."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(1, horizon)
    # A null keeps its place inside the struct.
    return rows.withColumn("ahead", F.collect_list(F.struct(F.col(value).alias("v"))).over(w))
