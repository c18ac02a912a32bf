"""Mixing sources to target weights by hash-random order and distributed prefix sums. No Python runs on the rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import with_row_key, written

#: Words: runs of anything but space and 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that stand in one range of keys, about; one task sums them up.
RANGE_ROWS = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, source_size, target for every source of sizes (columns source, source_size; one row a source, a null last).

    The sources by code point weigh as weights says, repeating, and share `share` times all sizes. A target stops at
    `most` times its source's size and the excess goes to the others by weight until none is above: that is the level
    at which the smaller of cap and level times weight adds up. Sources are met in the order in which they fill up,
    so one pass over running sums finds the level. Only one row a source is handled here, never the documents.
    """
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("_i", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))).withColumn("_w", cycle)
    ranked = ranked.withColumn("_cap", F.col("source_size") * float(most))
    by_fill = W.orderBy(F.col("_cap") / F.col("_w"), "_i")
    total = F.sum("source_size").over(W.partitionBy()) * float(share)
    # What is left for this source and those that fill up later, and how much they weigh.
    left = total - F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    weigh = F.sum("_w").over(by_fill.rowsBetween(0, W.unboundedFollowing))
    full = ranked.withColumn("_level", left / weigh).withColumn("_full", F.col("_level") * F.col("_w") >= F.col("_cap"))
    # The first source that doesn't fill up sets the level for all after it.
    level = F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(by_fill.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return full.withColumn("target", F.least(F.col("_cap"), F.coalesce(level * F.col("_w"), F.col("_cap")))).select("source", "source_size", "target")


def mix(docs: DataFrame, key_cols: list[str], id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", digits: int | None = None) -> DataFrame:
    """key_cols plus source, size, source_size, target and taken for every row: how many words of it the mix takes.

    Each row draws a hash-random key from seed and its id, or its text where it has none, so reruns agree. Within a source,
    rows stand in key order; the first `digits` hex digits of the key (as many as leave about RANGE_ROWS rows to a range, where
    none are given) cut that order into ranges of equal chance, sums over the ranges of each source give every range its start,
    and running sums inside a range give every row its own. A source is taken whole for as
    many epochs as its target holds, then once more up to the exact word where the target ends.
    A null text has size 0 and takes nothing; a null source is a source of its own, the last. Rows of one key stand
    by id, size and key_cols. An empty table gives no rows. Columns other than those named play no part.
    """
    base = docs.select(*key_cols, F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("_size"), F.when(F.col(id_col).isNull(), F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_digest"))
    keyed = base.withColumn("_key", F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.col("_digest")))), 1, 16))
    keyed = written(keyed.drop("_digest"), "sizes")
    if digits is None:
        digits = max(3, math.ceil(math.log(max(keyed.count() / RANGE_ROWS, 1), 16)))
    keyed = keyed.withColumn("_range", F.conv(F.substring("_key", 1, digits), 16, 10).cast("long"))
    ranges = keyed.groupBy("_source", "_range").agg(F.sum("_size").alias("_sum"))
    goals = targets(ranges.groupBy(F.col("_source").alias("source")).agg(F.sum("_sum").alias("source_size")), list(weights), share, most)
    starts = ranges.withColumn("_start", F.sum("_sum").over(W.partitionBy("_source").orderBy("_range")) - F.col("_sum")).select("_source", "_range", "_start")
    plan = starts.join(goals, starts["_source"].eqNullSafe(goals["source"])).drop("source")
    plan = plan.withColumnsRenamed({"_source": "_s", "_range": "_r"})
    inside = W.partitionBy("_source", "_range").orderBy("_key", "_id", "_size", *key_cols).rowsBetween(W.unboundedPreceding, 0)
    own = keyed.withColumn("_before", F.sum("_size").over(inside) - F.col("_size"))
    met = own.join(plan, own["_source"].eqNullSafe(plan["_s"]) & (own["_range"] == plan["_r"]))
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = goal - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("_size"), rest - F.col("_start") - F.col("_before")))
    return met.select(*key_cols, F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", (epochs * F.col("_size") + last).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The mix itself, with the columns of docs: each row as often as the mix takes it whole, and where the budget ends
    inside it, once more cut after the last word that fits. Rows that the mix takes no word of are left out."""
    cols = docs.columns
    keyed = with_row_key(docs)
    taken = mix(keyed, ["_rk_file", "_rk_row"], text_col=text_col, **options).where("taken > 0").select("_rk_file", "_rk_row", F.col("size").alias("_size"), F.col("taken").alias("_taken"))
    met = keyed.join(taken, ["_rk_file", "_rk_row"])
    epochs = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    rest = F.col("_taken") - epochs * F.col("_size")
    words = F.concat(F.array_repeat(F.col("_size"), epochs), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    out = met.withColumn("_words", F.explode(words))
    cut = _first_words(F.col(text_col), F.col("_words"))
    return out.withColumn(text_col, F.when(F.col("_words") < F.col("_size"), cut).otherwise(F.col(text_col))).select(*cols)


def _first_words(text: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), n.cast("int")), " ")


#: DuckDB's version of op1's rows.
OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         substr(md5(concat('mix:', coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))), 1, 16) AS k
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, (CASE (i - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END)::DOUBLE AS w, (source_size * 2)::DOUBLE AS cap FROM s),
l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size,
         least(cap, coalesce(w * (SELECT level FROM l m WHERE m.level * m.w < m.cap ORDER BY m.cap / m.w, m.i LIMIT 1), cap)) AS target FROM l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS goal,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (goal // source_size) * size + greatest(0, least(size, goal - (goal // source_size) * source_size - before)) END::BIGINT AS taken
FROM r
"""
