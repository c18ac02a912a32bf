"""From feature bars to model rows, signals and backtest metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import coin_key
from ..functions.columns import action, hour_angle
from .bars import frame, latest
from .features import news_columns
from .joins import not_in, wide_by

# Lags of a coin's own return, bars of the volume mean, and the model variants in the order of reports.
OWN_LAGS = (1, 2, 3)
VOLUME_WINDOW = 24
VARIANTS = ("price+news", "price_only")
PORTFOLIO = "ALL (equal weight)"


def model_frame(features: DataFrame, targets: tuple[str, ...], inputs: tuple[str, ...], horizon: int) -> tuple[DataFrame, list[str]]:
    """Rows of the target coins with their features and label, and the features' names.

    label is 1 or 0 by whether the close `horizon` bars on is higher, null where that isn't known: such rows can be
    predicted but not learned from. features: rows of one frequency, on each coin's regular grid.
    """
    w = W.partitionBy("coin").orderBy("bucket")
    news = news_columns(features.columns)
    volume = F.avg("volume").over(frame(["coin"], "bucket", VOLUME_WINDOW))
    rows = features.withColumns({"ret": F.col("log_return"), **{f"ret_lag{k}": F.lag("log_return", k).over(w) for k in OWN_LAGS}, "volume_ratio": F.when(volume > 0, F.col("volume") / F.nullif(volume, F.lit(0.0)))})
    rows = rows.withColumn("future_return", F.log(F.nullif(F.lead("close", horizon).over(w), F.lit(0.0)) / F.nullif(F.col("close"), F.lit(0.0))))
    rows = rows.withColumn("label", F.when(F.col("future_return").isNotNull(), (F.col("future_return") > 0).cast("double")))
    wide = wide_by(rows, "coin", {c: coin_key(c) for c in inputs}, "bucket", {"log_return": "ret", "ret_lag1": "ret_lag1", "realized_vol": "rv"})
    sin, cos = hour_angle(F.col("bucket"))
    dummies = [f"coin_{coin_key(c)}" for c in sorted(targets)]
    own = ["ret", *[f"ret_lag{k}" for k in OWN_LAGS], "realized_vol", "ret_vol_short", "ret_vol_long", "volume_ratio"]
    fed = [f"{coin_key(c)}_{s}" for c in inputs for s in ("ret", "ret_lag1", "rv")]
    out = rows.where(F.col("coin").isin(list(targets))).join(wide, "bucket", "left")
    out = out.withColumns({"hour_sin": sin, "hour_cos": cos, **{d: (F.col("coin") == c).cast("double") for d, c in zip(dummies, sorted(targets), strict=True)}})
    names = own + fed + news + ["hour_sin", "hour_cos"] + dummies
    return out.select("bucket", "coin", "close", "is_complete", "future_return", "label", *[F.col(n).cast("double").alias(n) for n in names]), names


def training_rows(rows: DataFrame, at: Column, horizon_seconds: int, window_bars: int) -> DataFrame:
    """Labelled rows that a model may learn from when it predicts at a bar: those whose outcome is known by then, the last window_bars of each coin."""
    known = rows.where((F.col("bucket") <= at - F.expr(f"interval {horizon_seconds} seconds")) & F.col("label").isNotNull() & F.col("close").isNotNull())
    return latest(known, ["coin"], ["bucket"], window_bars)


def with_next_return(rows: DataFrame) -> DataFrame:
    return rows.withColumn("next_return", F.lead("close").over(W.partitionBy("coin").orderBy("bucket")) / F.nullif(F.col("close"), F.lit(0.0)) - 1)


def strategy_returns(preds: DataFrame, keys: list[str], fee_bps: float) -> DataFrame:
    """Long-only: BUY holds, SELL leaves, HOLD keeps what is, none before the first. Adds position, fee, trade, strategy_return."""
    w = W.partitionBy(*keys).orderBy("bucket")
    told = F.when(F.col("action") == "BUY", 1.0).when(F.col("action") == "SELL", 0.0)
    out = preds.withColumn("position", F.coalesce(F.last(told, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0)))
    out = out.withColumn("_t", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))
    out = out.withColumns({"fee": F.col("_t") * (fee_bps / 10_000), "trade": F.col("_t") > 0})
    return out.withColumn("strategy_return", F.col("position") * F.col("next_return") - F.col("fee")).drop("_t")


def equity(rows: DataFrame, keys: list[str], returns: str, name: str) -> DataFrame:
    """Adds the drawdown of each row: equity over its highest so far, less 1. The first peak is the first row's equity."""
    w = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    out = rows.withColumn("_e", F.product(1 + F.col(returns)).over(w))
    return out.withColumn(name, F.col("_e") / F.nullif(F.max("_e").over(w), F.lit(0.0)) - 1).drop("_e")


def auc(rows: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area under the curve by ranks, ties shared; null if only one class is there."""
    by = W.partitionBy(*keys)
    some = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    rank = F.rank().over(by.orderBy(score)) + (F.count("*").over(W.partitionBy(*keys, score)) - 1) / 2.0
    g = some.withColumn("_r", rank).groupBy(*keys).agg(F.sum(F.when(F.col(label) == 1, F.col("_r"))).alias("_s"), F.count_if(F.col(label) == 1).cast("double").alias("_p"), F.count_if(F.col(label) == 0).cast("double").alias("_n"))
    value = (F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2) / F.nullif(F.col("_p") * F.col("_n"), F.lit(0.0))
    return g.select(*keys, value.alias("auc"))


def prediction_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    known = F.col("label").isNotNull()
    right = F.when(known, ((F.col("prob_up") > 0.5) == (F.col("label") == 1)).cast("int"))
    is_ = lambda a: F.count_if(F.col("action") == a)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("bars"), is_("BUY").alias("buy"), is_("SELL").alias("sell"), is_("HOLD").alias("hold"), F.avg(right).alias("accuracy"), F.greatest(F.avg("label"), 1 - F.avg("label")).alias("baseline_accuracy"),
        F.avg(F.when(known & (F.col("action") == "BUY"), (F.col("label") == 1).cast("int"))).alias("buy_hit_rate"), F.avg(F.when(known & (F.col("action") == "SELL"), (F.col("label") == 0).cast("int"))).alias("sell_hit_rate"),
        F.count_if("trade").alias("trades"),
    )
    return out.join(auc(rows, keys, "label", "prob_up"), keys, "left")


def return_metrics(rows: DataFrame, keys: list[str]) -> DataFrame:
    out = equity(equity(rows, keys, "strategy_return", "_d"), keys, "next_return", "_b")
    return out.groupBy(*keys).agg((F.product(1 + F.col("strategy_return")) - 1).alias("strategy_return"), (F.product(1 + F.col("next_return")) - 1).alias("buy_hold_return"), F.avg("position").alias("time_in_market"), F.min("_d").alias("max_drawdown"), F.min("_b").alias("buy_hold_max_drawdown"))


def evaluate(preds: DataFrame, fee_bps: float) -> tuple[DataFrame, DataFrame]:
    """Trading rows, and metrics of each variant and coin and of an equal-weight portfolio, which trades the mean of the coins bar by bar."""
    traded = strategy_returns(preds, ["variant", "coin"], fee_bps)
    single = prediction_metrics(traded, ["variant", "coin"]).join(return_metrics(traded, ["variant", "coin"]), ["variant", "coin"])
    bars = traded.groupBy("variant", "bucket").agg(*[F.avg(c).alias(c) for c in ("strategy_return", "next_return", "position")])
    whole = prediction_metrics(traded, ["variant"]).join(return_metrics(bars, ["variant"]), ["variant"]).withColumn("coin", F.lit(PORTFOLIO))
    return traded, single.unionByName(whole)


def in_report_order(metrics: DataFrame) -> DataFrame:
    place = F.when(F.col("variant") == VARIANTS[0], 0).otherwise(1)
    return metrics.orderBy((F.col("coin") == PORTFOLIO).cast("int"), "coin", place)


def best_candidate(results: DataFrame) -> DataFrame:
    """The row of highest return, of several the one of fewest trades, then the first."""
    return results.orderBy(F.desc_nulls_last("strategy_return"), F.asc("trades"), F.asc("candidate")).limit(1)


def latest_signals(rows: DataFrame, buy: float, sell: float) -> DataFrame:
    return latest(rows.where(F.col("close").isNotNull()), ["coin"], ["bucket"]).withColumn("action", action(F.col("prob_up"), buy, sell))


def to_replay(bars: DataFrame, done: DataFrame) -> DataFrame:
    """Bars of coins for which there is no signal yet."""
    return not_in(bars, done, ["symbol", "bucket"])


def compare_signals(live: DataFrame, replay: DataFrame) -> DataFrame:
    """Shared bars, share of equal actions and mean difference of probabilities."""
    r = replay.select("symbol", "bucket", F.col("action").alias("_a"), F.col("prob_up").alias("_p"))
    met = live.join(r, ["symbol", "bucket"])
    return met.agg(F.count("*").alias("n"), F.avg((F.col("action") == F.col("_a")).cast("int")).alias("agreement"), F.avg(F.abs(F.col("prob_up") - F.col("_p"))).alias("mean_abs_diff"))


def chart_history(signals: DataFrame, bar_seconds: int) -> DataFrame:
    """Signals with changed, source and latency, and a row without values before each bar that follows a hole of more than one and a half bars."""
    from ..functions.columns import origin

    w = W.partitionBy("symbol").orderBy("bucket")
    step = F.expr(f"interval {bar_seconds} seconds")
    out = signals.withColumns({"changed": F.coalesce(F.col("action") != F.lag("action").over(w), F.lit(True)), "source": origin(F.col("model_version")), "_before": F.lag("bucket").over(w)})
    holes = out.where(F.col("bucket") > F.col("_before") + F.expr(f"interval {bar_seconds * 3 // 2} seconds")).select("symbol", (F.col("bucket") - step).alias("bucket"))
    return out.drop("_before").unionByName(holes, allowMissingColumns=True)


def missing_bars(signals: DataFrame, bar_seconds: int) -> DataFrame:
    w = W.partitionBy("symbol").orderBy("bucket")
    gap = F.timestamp_diff("SECOND", F.lag("bucket").over(w), F.col("bucket")) / bar_seconds
    return signals.select("symbol", F.greatest(F.round(gap) - 1, F.lit(0)).cast("long").alias("n")).groupBy("symbol").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("missing"))


def by_variant(metrics: DataFrame, value: str) -> DataFrame:
    """One row a coin with a column for each variant."""
    return metrics.groupBy("coin").pivot("variant", list(VARIANTS)).agg(F.first(value))
