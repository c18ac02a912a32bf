"""Bars of prices and of scored articles, on regular grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bucket, symbol_of


def candles_from_ticks(ticks: DataFrame, seconds: int = 60) -> DataFrame:
    """Candles of ticks (time, symbol, price, seq): first, highest, lowest and last price, sum and count of each interval."""
    order = F.struct("time", "seq")
    return (
        ticks.groupBy("symbol", bucket("time", seconds).alias("time"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum(F.col("price").cast("double")).alias("volume"), F.count("*").alias("n_ticks"))
    )


def with_minute_returns(candles: DataFrame) -> DataFrame:
    """candles plus r1m, the log return over the minute before; null unless there was a candle exactly then and both prices are positive."""
    w = W.partitionBy("symbol").orderBy("time")
    adjacent = F.lag("time").over(w) == F.col("time") - F.expr("interval 1 minute")
    before = F.lag("close").over(w)
    return candles.withColumn("r1m", F.when(adjacent & (before > 0) & (F.col("close") > 0), F.log(F.col("close") / F.nullif(before, F.lit(0.0)))))


def market_bars(candles: DataFrame, seconds: int) -> DataFrame:
    """One row for each symbol and bar with candles: open, high, low, close, volume, n_candles, realized_vol (null without a minute return).

    candles: with_minute_returns(). First and last go by time, never by the order of rows; partial sums are taken before rows meet.
    """
    return (
        candles.groupBy("symbol", bucket("time", seconds).alias("bucket"))
        .agg(F.min_by("open", "time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "time").alias("close"), F.sum(F.col("volume").cast("double")).alias("volume"), F.count("*").alias("n_candles"), F.sqrt(F.sum(F.col("r1m") * F.col("r1m"))).alias("realized_vol"))
    )


def last_close(candles: DataFrame, seconds: int) -> DataFrame:
    return candles.groupBy("symbol", bucket("time", seconds).alias("bucket")).agg(F.max_by("close", "time").alias("close"), F.count("*").alias("n_candles"))


def earliest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; ties go on to the next column of order, so one row is always the same."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def latest(rows: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The last n rows of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))).where(F.col("_n") <= n).drop("_n")


def dedup_articles(scores: DataFrame) -> DataFrame:
    """One row for each coin and url: the earliest."""
    return earliest(scores, ["coin", "url"], ["time", "finbert_compound", "vader_compound"])


def sentiment_bars(scores: DataFrame, seconds: int) -> DataFrame:
    """One row for each symbol and bar with articles: n_articles, n_positive, n_negative, finbert_mean, vader_mean. scores: dedup_articles()."""
    is_ = lambda what: F.sum((F.col("finbert_label") == what).cast("int"))
    return (
        scores.groupBy(symbol_of(F.col("coin")).alias("symbol"), bucket("time", seconds).alias("bucket"))
        .agg(F.count("*").alias("n_articles"), is_("positive").alias("n_positive"), is_("negative").alias("n_negative"), F.avg("finbert_compound").alias("finbert_mean"), F.avg("vader_compound").alias("vader_mean"))
    )


def grid(bars: DataFrame, keys: list[str], seconds: int, time: str = "bucket") -> DataFrame:
    """Every bar from each key's first to its last."""
    step = F.expr(f"interval {seconds} seconds")
    return bars.groupBy(*keys).agg(F.min(time).alias("_a"), F.max(time).alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b", step)).alias(time))


def on_grid(bars: DataFrame, keys: list[str], seconds: int, time: str = "bucket") -> DataFrame:
    """bars with a row of nulls for each bar that is missing between a key's first and last."""
    return grid(bars, keys, seconds, time).join(bars, [*keys, time], "left")


def log_return(close: Column, w: W) -> Column:
    return F.log(F.nullif(close, F.lit(0.0))) - F.log(F.nullif(F.lag(close).over(w), F.lit(0.0)))


def frame(keys: list[str], order: str, n: int):
    """The last n rows of each key up to the present one."""
    return W.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)


def time_window_bars(ticks: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Candles of tumbling or sliding windows, for batch and for streams with a watermark."""
    order = F.struct("time", "seq")
    return ticks.groupBy("symbol", F.window("time", length, slide).alias("w")).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").alias("n")).select("symbol", F.col("w.start").alias("bucket"), F.col("w.end").alias("bucket_end"), "open", "high", "low", "close", "n")


def session_bars(rows: DataFrame, key: str, gap: str) -> DataFrame:
    """Runs of rows of a key that are at most a gap apart, as sessions with their number of rows."""
    return rows.groupBy(key, F.session_window("time", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
