"""Lag statistics: aligned series, cross-correlation, multiple testing, rolling scans."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bars import log_return, on_grid
from .islands import longest_run, runs_where


def aligned(market: DataFrame, sentiment: DataFrame, seconds: int, expected: int, fill: str = "zero") -> DataFrame:
    """Market bars (symbol, bucket, close, n_candles) on their grid with sentiment bars (sent_mean, sent_sum, n_articles):
    a missing bar is a row without a close. sentiment is 0 without articles, or with fill='ffill' the last one seen.
    A symbol's last bar goes while it lacks candles."""
    by = W.partitionBy("symbol")
    w = by.orderBy("bucket")
    g = on_grid(market, ["symbol"], seconds).withColumn("n_candles", F.coalesce("n_candles", F.lit(0)))
    g = g.withColumn("_z", F.max("bucket").over(by)).where((F.col("bucket") < F.col("_z")) | (F.col("n_candles") >= expected)).drop("_z")
    df = g.join(sentiment, ["symbol", "bucket"], "left").withColumn("n_articles", F.coalesce("n_articles", F.lit(0)))
    filled = F.last("sent_mean", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)) if fill == "ffill" else F.col("sent_mean")
    df = df.withColumns({"sentiment": F.coalesce(filled, F.lit(0.0)), "log_return": log_return(F.col("close"), w)})
    return df.withColumn("abs_return", F.abs("log_return"))


def diagnostics(df: DataFrame, expected: int) -> DataFrame:
    """One row a symbol: bars, valid, partial and empty ones, coverage by articles, and its gaps as an array."""
    missing = runs_where(df, ["symbol"], "bucket", F.col("close").isNull())
    runs = missing.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("n").alias("bars")))).alias("gaps"))
    n = df.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), F.count("log_return").alias("n_valid"), F.count_if(F.col("close").isNotNull() & (F.col("n_candles") < expected)).alias("n_partial"), F.count_if(F.col("close").isNull()).alias("n_empty"), F.avg((F.col("n_articles") > 0).cast("int")).alias("coverage")
    )
    return n.join(runs, "symbol", "left")


def indexed(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("i", F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1)


def safe_corr(a: str, b: str) -> Column:
    """Pearson correlation; null for fewer than two rows or a constant."""
    return F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0))


def cross_correlation(df: DataFrame, keys: list[str], order: str, cause: str, effect: str, max_lag: int, alpha: float = 0.05) -> DataFrame:
    """For each lag k from -max_lag to max_lag the correlation of cause at t - k with effect at t, over rows where both are
    there: keys, lag, n, corr, band, significant, bonferroni_band, significant_bonferroni.

    The shifted pairs are an equality join on the row's number, so lags spread over tasks.
    """
    rows = indexed(df, keys, order)
    left = rows.select(*keys, F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"), F.col("i"), F.col(cause).alias("_c")).where(F.col("_c").isNotNull()).withColumn("_j", F.col("i") + F.col("lag")).drop("i")
    right = rows.select(*keys, F.col("i").alias("_j"), F.col(effect).alias("_e")).where(F.col("_e").isNotNull())
    out = left.join(right, [*keys, "_j"]).groupBy(*keys, "lag").agg(F.count("*").alias("n"), safe_corr("_c", "_e").alias("corr"))
    z, zb = NormalDist().inv_cdf(1 - alpha / 2), NormalDist().inv_cdf(1 - alpha / (2 * max_lag))
    band, strict = F.lit(z) / F.sqrt("n"), F.lit(zb) / F.sqrt("n")
    return out.withColumns({"band": band, "significant": F.abs("corr") > band, "bonferroni_band": strict, "significant_bonferroni": F.abs("corr") > strict})


def peak_lag(ccf: DataFrame, keys: list[str], lead: bool = True) -> DataFrame:
    """The lag of largest absolute correlation among those above zero (cause leads), or below; of several the smallest lag."""
    some = ccf.where((F.col("lag") > 0) if lead else (F.col("lag") < 0)).where(F.col("corr").isNotNull())
    best = F.max_by(F.struct("lag", "corr", "n"), F.struct(F.abs("corr"), -F.col("lag")))
    return some.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.lag").alias("lag"), F.col("b.corr").alias("corr"), F.col("b.n").alias("n"))


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, order: str) -> DataFrame:
    """p_fdr: p times tests over rank, the least of those at or above it, at most 1. Null p stays null and counts as no test."""
    test = F.col(p).isNotNull()
    by = W.partitionBy(*keys)
    m = F.count(p).over(by)
    ranked = df.withColumn("_r", F.row_number().over(by.orderBy(F.asc_nulls_last(p), order))).withColumn("_q", F.when(test, F.col(p) * m / F.col("_r")))
    return ranked.withColumn("p_fdr", F.when(test, F.least(F.min("_q").over(by.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, 0)), F.lit(1.0)))).drop("_r", "_q")


def windows_of(df: DataFrame, keys: list[str], order: str, window: int, step: int) -> DataFrame:
    """Each row once for every full window of `window` rows, begun every `step` rows, that it is in: adds window_id, window_start."""
    rows = indexed(df, keys, order).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    first = F.greatest(F.ceil((F.col("i") - (window - 1)) / step), F.lit(0))
    last = F.least(F.floor(F.col("i") / step), F.floor((F.col("_n") - window) / step))
    out = rows.where(F.col("_n") >= window).withColumns({"_a": first, "_b": last}).where("_a <= _b")
    out = out.withColumn("window_id", F.explode(F.sequence("_a", "_b"))).drop("_a", "_b", "_n")
    return out.withColumn("window_start", F.min(order).over(W.partitionBy(*keys, "window_id")))


def rolling_scan(df: DataFrame, keys: list[str], order: str, cause: str, effect: str, window: int, step: int, max_lag: int, min_coverage: float, alpha: float = 0.05) -> DataFrame:
    """Peak lead lag of every window, and its status: ok, skipped_low_coverage (too few bars with articles), skipped_gap (a missing value) or skipped_constant."""
    lag = max(1, min(max_lag, window // 8))
    parts = windows_of(df, keys, order, window, step)
    by = [*keys, "window_id"]
    state = parts.groupBy(*by).agg(F.min("window_start").alias("window_start"), F.avg((F.col("n_articles") > 0).cast("int")).alias("coverage"), F.count_if(F.col(cause).isNull() | F.col(effect).isNull()).alias("_gaps"), F.stddev_samp(cause).alias("_sc"), F.stddev_samp(effect).alias("_se"))
    status = F.when(F.col("_gaps") > 0, "skipped_gap").when(F.col("coverage") < min_coverage, "skipped_low_coverage").when((F.col("_sc") == 0) | (F.col("_se") == 0), "skipped_constant").otherwise("ok")
    state = state.withColumn("status", status).drop("_gaps", "_sc", "_se")
    peak = peak_lag(cross_correlation(parts.join(state.where("status = 'ok'").select(*by), by, "left_semi"), by, order, cause, effect, lag, alpha), by)
    return state.join(peak, by, "left")


def summarize_scan(scan: DataFrame, keys: list[str]) -> DataFrame:
    """Of the windows that are ok: their number, the most frequent peak lag (the smallest of several), its spread."""
    ok = F.col("status") == "ok"
    return scan.groupBy(*keys).agg(F.count("*").alias("n_windows"), F.count_if(ok).alias("n_ok"), F.mode(F.when(ok, F.col("lag")), True).alias("mode_lag"), F.stddev_samp(F.when(ok, F.col("lag"))).alias("std_lag"))


def longest_complete_run(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Start, end and length of each key's longest run of rows in which no column is null, of several the first."""
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    return longest_run(runs_where(df, keys, order, whole), keys)


def difference(df: DataFrame, keys: list[str], order: str, column: str) -> DataFrame:
    return df.withColumn(column, F.col(column) - F.lag(column).over(W.partitionBy(*keys).orderBy(order)))


def reduced_lag(max_lag: int, n_valid: int) -> int:
    """No more lags than a fifth of the valid bars."""
    return max_lag if n_valid >= 5 * max_lag else max(1, n_valid // 5)
