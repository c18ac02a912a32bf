"""Event study: clusters of strong articles, cumulative returns after them, significance and exits."""

from __future__ import annotations



import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import earliest
from .islands import clusters, first_run, runs_where
from .joins import as_of, offset_pairs
from .lagstats import benjamini_hochberg


def strong_articles(scores: DataFrame, column: str, threshold: float) -> DataFrame:
    """coin, time, url, score of articles whose score is at least the threshold from zero; of one url of a coin the earliest such."""
    if column not in ("finbert_compound", "vader_compound"):
        raise ValueError(f"no sentiment column {column!r}")
    some = scores.where(F.abs(column) >= threshold).select("coin", "time", "url", F.col(column).alias("score"))
    return earliest(some, ["coin", "url"], ["time", "score"])


def cluster_events(articles: DataFrame, hours: float) -> DataFrame:
    """coin, event_time, direction, magnitude, n_articles: articles at most so many hours after the one before are one event.
    Its direction is the sign of the mean score, negative for exactly 0; its magnitude the mean absolute score."""
    ids = clusters(articles, ["coin"], "time", round(hours * 3600))
    out = ids.groupBy("coin", "cluster").agg(F.min("time").alias("event_time"), F.avg("score").alias("_m"), F.avg(F.abs("score")).alias("magnitude"), F.count("*").alias("n_articles"))
    return out.select("coin", "event_time", F.when(F.col("_m") > 0, "positive").otherwise("negative").alias("direction"), "magnitude", "n_articles")


def event_car(events: DataFrame, closes: DataFrame, horizon: int, chunk_seconds: int | None = None) -> DataFrame:
    """events (with a symbol) exploded to h from 1 to horizon: base price (the last close at or before the event), car (log
    return from it to the h-th bar after), null past the end or at a bad price.

    Each close carries the next `horizon` closes from one frame; events then find their bar by an as-of join.
    """
    ahead = offset_pairs(closes.select("symbol", "bucket", "close"), ["symbol"], "bucket", "close", horizon)
    met = as_of(events, ahead, ["symbol"], "event_time", "bucket", ["close", "ahead"], chunk_seconds)
    out = met.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("_p", F.try_element_at("ahead", F.col("h"))["v"])
    car = F.when((F.col("close") > 0) & (F.col("_p") > 0), F.log(F.col("_p") / F.nullif(F.col("close"), F.lit(0.0))))
    return out.withColumn("car", car).withColumnRenamed("close", "base_price").drop("ahead", "_p")


def mean_car(cars: DataFrame, keys: list[str]) -> DataFrame:
    return cars.groupBy(*keys, "h").agg(F.avg("car").alias("mean_car"), F.count("car").alias("n"))


def baseline_starts(closes: DataFrame, horizon: int, n: int, seed: int) -> DataFrame:
    """n pseudo-random start rows of each symbol, drawn with replacement from all but the last horizon + 1: symbol, draw, i.

    Draws come from a hash of symbol, draw and seed, so they are the same on every machine and retry.
    """
    sizes = closes.groupBy("symbol").agg((F.count("*") - (horizon + 1)).alias("_n")).where("_n > 0")
    return sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("i", F.pmod(F.xxhash64("symbol", "draw", F.lit(seed)), F.col("_n")).cast("int")).drop("_n")


def baseline_car(closes: DataFrame, horizon: int, n: int, seed: int = 42) -> DataFrame:
    """Cumulative returns from the drawn rows: symbol, draw, h, car."""
    w = W.partitionBy("symbol").orderBy("bucket")
    rows = offset_pairs(closes.select("symbol", "bucket", "close"), ["symbol"], "bucket", "close", horizon).withColumn("i", F.row_number().over(w) - 1)
    met = baseline_starts(closes, horizon, n, seed).join(rows, ["symbol", "i"]).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    p = F.try_element_at("ahead", F.col("h"))["v"]
    return met.select("symbol", "draw", "h", F.when((F.col("close") > 0) & (p > 0), F.log(p / F.nullif(F.col("close"), F.lit(0.0)))).alias("car"))


def bootstrap_p(cars: DataFrame, baseline: DataFrame, keys: list[str], n_bootstrap: int = 1000, seed: int = 7) -> DataFrame:
    """Two-sided p of the mean return of each (keys, direction, h) against means of as many baseline draws; null without
    an observation or with fewer than ten draws. One Arrow group holds one horizon's values, never a whole table."""
    schema = ", ".join(f"{k} string" for k in keys) + ", direction string, h int, n long, mean_car double, p double"

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        draws = right["car"].dropna().to_numpy()
        rng = np.random.default_rng([seed, int(key[-1])])
        out = []
        for direction, g in left.groupby("direction"):
            x = g["car"].dropna().to_numpy()
            p = None
            if len(x) and len(draws) >= 10:
                means = rng.choice(draws, (n_bootstrap, len(x))).mean(axis=1)
                p = min(1.0, 2 * min((means >= x.mean()).mean(), (means <= x.mean()).mean()))
            out.append((*key[:-1], direction, key[-1], len(x), x.mean() if len(x) else None, p))
        return pd.DataFrame(out, columns=[*keys, "direction", "h", "n", "mean_car", "p"])

    left = cars.select(*keys, "h", "direction", "car")
    right = baseline.select(*keys, "h", "car")
    return left.groupBy(*keys, "h").cogroup(right.groupBy(*keys, "h")).applyInPandas(run, schema)


def significance(tested: DataFrame, keys: list[str], alpha: float, min_effect: float) -> DataFrame:
    """Adds p_fdr over the horizons of each key, significant_fdr, and significant: that, and a mean return of at least min_effect."""
    out = benjamini_hochberg(tested, keys, "p", "h").withColumn("significant_fdr", F.coalesce(F.col("p_fdr") < alpha, F.lit(False)))
    return out.withColumn("significant", F.col("significant_fdr") & F.coalesce(F.abs("mean_car") >= min_effect, F.lit(False)))


def onset(tested: DataFrame, keys: list[str], min_run: int) -> DataFrame:
    """First h of the first run of at least min_run significant horizons."""
    return first_run(runs_where(tested, keys, "h", F.col("significant")), keys, min_run)


def optimal_exit(cars: DataFrame, keys: list[str]) -> DataFrame:
    """For each event the h of its best return: the largest after positive news, the smallest after negative; of several the first."""
    up = F.max_by(F.struct("h", "car"), F.struct("car", -F.col("h")))
    down = F.min_by(F.struct("h", "car"), F.struct("car", "h"))
    best = cars.where(F.col("car").isNotNull()).groupBy(*keys, "direction").agg(up.alias("u"), down.alias("d"))
    pick = F.when(F.col("direction") == "positive", F.col("u")).otherwise(F.col("d"))
    return best.select(*keys, "direction", pick["h"].alias("exit_h"), pick["car"].alias("exit_car"))


def exit_distribution(exits: DataFrame, keys: list[str]) -> DataFrame:
    """Number, quartiles (exact, linear between) and the median as a whole hour, halves to even."""
    q = lambda p: F.percentile("exit_h", F.lit(p))
    return exits.groupBy(*keys).agg(F.count("*").alias("n"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75")).withColumn("median_h", F.bround("median", 0).cast("int"))


def study(scores: DataFrame, closes: DataFrame, causes: list[str], column: str, threshold: float, cluster_hours: float, horizon: int, n_baseline: int, n_bootstrap: int, min_events: int, alpha: float, min_run: int, min_effect: float) -> dict[str, DataFrame]:
    """All cause and target pairs at once: events, cars, significance, onset and exits, for pairs with enough events."""
    events = cluster_events(strong_articles(scores.where(F.col("coin").isin(causes)), column, threshold), cluster_hours)
    enough = events.groupBy("coin").count().where(F.col("count") >= min_events).select("coin")
    events = events.join(enough, "coin", "left_semi").withColumnRenamed("coin", "cause")
    targets = closes.select("symbol").distinct()
    pairs = events.join(F.broadcast(targets))  # as many rows as events times coins, and coins are a configured list
    cars = event_car(pairs, closes, horizon)
    tested = bootstrap_p(cars, baseline_car(closes, horizon, n_baseline).join(pairs.select("cause", "symbol").distinct(), "symbol"), ["cause", "symbol"], n_bootstrap)
    tested = significance(tested, ["cause", "symbol", "direction"], alpha, min_effect)
    exits = optimal_exit(cars, ["cause", "symbol", "event_time"])
    return {"events": events, "cars": cars, "significance": tested, "onset": onset(tested, ["cause", "symbol", "direction"], min_run), "exits": exit_distribution(exits, ["cause", "symbol", "direction"])}


