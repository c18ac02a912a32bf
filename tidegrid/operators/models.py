"""Fitting and predicting: live signals, replays and walk-forward backtests, one Arrow group a model."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import action, version_name
from .bars import latest
from .features import news_columns
from .gbdt import Booster
from .trading import VARIANTS, best_candidate, evaluate, with_next_return


def _fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, so that both sides of a cogroup may stem from one frame."""
    return df.toDF(*df.columns)


def _predict(train: pd.DataFrame, rows: pd.DataFrame, names: list[str], params: dict):
    train = train.sort_values(["coin", "bucket"])
    model = Booster(**params).fit(train[names].to_numpy(float), train["label"].to_numpy(float))
    return model.predict(rows[names].to_numpy(float)), model.n_train


def walk_forward(frame: DataFrame, names: list[str], start: str, end: str, bar_seconds: int, horizon_bars: int, retrain_every: int, window_bars: int, params: dict, buy: float, sell: float) -> DataFrame:
    """Predictions of every priced bar in [start, end) by both variants: variant, coin, bucket, prob_up, action, label, next_return, n_train.

    The test bars fall into blocks of retrain_every bars. A row is learned from in every block at whose start its outcome was
    known, so each row goes to the blocks it may teach, and every block and variant fits its model in a group of its own:
    a group holds window_bars rows a coin, whatever the table's size.
    """
    step = bar_seconds * retrain_every
    at = lambda s: F.lit(s).cast(frame.schema["bucket"].dataType)
    rows = with_next_return(frame)
    test = rows.where((F.col("bucket") >= at(start)) & (F.col("bucket") < at(end)) & F.col("close").isNotNull() & F.col("next_return").isNotNull())
    test = test.withColumn("block", F.floor(F.timestamp_diff("SECOND", at(start), F.col("bucket")) / step).cast("int"))
    # First block that starts no earlier than the row's outcome, and the last one before the end.
    known = F.timestamp_diff("SECOND", at(start), F.col("bucket")) + horizon_bars * bar_seconds
    blocks = test.select("block").distinct()
    first = F.greatest(F.ceil(known / step), F.lit(0)).cast("int")
    taught = rows.where(F.col("label").isNotNull() & F.col("close").isNotNull()).withColumn("_f", first)
    # Rows newer than this one by each block decide whether it is still within the window; a row serves blocks in a run.
    taught = taught.withColumn("_newer", F.lead("_f", window_bars).over(W.partitionBy("coin").orderBy("bucket")))
    last = F.coalesce(F.col("_newer") - 1, F.timestamp_diff("SECOND", at(start), at(end)).cast("int"))
    last = F.least(last, F.floor((F.timestamp_diff("SECOND", at(start), at(end)) - 1) / step).cast("int"))
    train = taught.withColumn("_l", last).where("_f <= _l").withColumn("block", F.explode(F.sequence("_f", "_l"))).drop("_f", "_l", "_newer").join(blocks, "block", "left_semi")
    variants = F.explode(F.array(*[F.lit(v) for v in VARIANTS]))
    news = set(news_columns(names))
    chosen = {VARIANTS[0]: names, VARIANTS[1]: [n for n in names if n not in news]}
    cols = ["block", "coin", "bucket", "label", "next_return", *names]
    left = test.select(*cols).withColumn("variant", variants)
    right = train.select(*[c for c in cols if c != "next_return"]).withColumn("variant", variants)
    schema = T.StructType([T.StructField("variant", T.StringType()), frame.schema["coin"], frame.schema["bucket"], T.StructField("prob_up", T.DoubleType()), T.StructField("label", T.DoubleType()), T.StructField("next_return", T.DoubleType()), T.StructField("n_train", T.LongType())])

    def run(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = rows[["variant", "coin", "bucket", "label", "next_return"]].copy()
        if len(rows):
            out["prob_up"], out["n_train"] = _predict(known, rows, chosen[key[1]], params)
        else:
            out["prob_up"], out["n_train"] = [], []
        return out[[f.name for f in schema]]

    preds = left.groupBy("block", "variant").cogroup(_fresh(right).groupBy("block", "variant")).applyInPandas(run, schema)
    return preds.withColumn("action", action(F.col("prob_up"), buy, sell))


def predict_at(frame: DataFrame, names: list[str], times: DataFrame, bar_seconds: int, horizon_bars: int, window_bars: int, min_train: int, params: dict, buy: float, sell: float) -> DataFrame:
    """Signals of each coin at each of the given buckets, by a model of what was known then; a coin with fewer labelled rows
    than min_train gets none: coin, bucket, prob_up, action, n_train. times: a small table of distinct buckets."""
    t = times.select(F.col("bucket").alias("_at")).distinct()
    span = F.expr(f"interval {horizon_bars * bar_seconds} seconds")
    labelled = frame.where(F.col("label").isNotNull() & F.col("close").isNotNull())
    # A range join on few times: each time takes the last window_bars rows of each coin.
    met = labelled.join(F.broadcast(t), F.col("bucket") <= F.col("_at") - span)
    train = latest(met, ["_at", "coin"], ["bucket"], window_bars)
    enough = train.groupBy("_at", "coin").count().where(F.col("count") >= min_train).select("_at", "coin")
    train = train.join(enough, ["_at", "coin"], "left_semi")
    rows = frame.where(F.col("close").isNotNull()).join(F.broadcast(t), F.col("bucket") == F.col("_at")).join(enough, ["_at", "coin"], "left_semi")
    schema = T.StructType([frame.schema["coin"], frame.schema["bucket"], T.StructField("prob_up", T.DoubleType()), T.StructField("n_train", T.LongType())])

    def run(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = rows[["coin", "bucket"]].copy()
        out["prob_up"], out["n_train"] = _predict(known, rows, names, params) if len(rows) else ([], [])
        return out[[f.name for f in schema]]

    preds = rows.select("_at", "coin", "bucket", *names).groupBy("_at").cogroup(_fresh(train.select("_at", "coin", "bucket", "label", *names)).groupBy("_at")).applyInPandas(run, schema)
    return preds.withColumn("action", action(F.col("prob_up"), buy, sell))


def generate_signals(frame: DataFrame, names: list[str], freq: str, bar_seconds: int, horizon_bars: int, window_bars: int, min_train: int, params: dict, buy: float, sell: float) -> DataFrame:
    """A signal for each coin's latest priced bar, by one model of all coins' rows that were known at the oldest of those bars."""
    now = latest(frame.where(F.col("close").isNotNull()), ["coin"], ["bucket"])
    cut = now.agg(F.min("bucket").alias("_at"))
    span = F.expr(f"interval {horizon_bars * bar_seconds} seconds")
    met = frame.where(F.col("label").isNotNull() & F.col("close").isNotNull()).join(F.broadcast(cut), F.col("bucket") <= F.col("_at") - span)
    train = latest(met, ["coin"], ["bucket"], window_bars)
    enough = train.groupBy("coin").count().where(F.col("count") >= min_train).select("coin")
    schema = T.StructType([frame.schema["coin"], frame.schema["bucket"], T.StructField("prob_up", T.DoubleType()), T.StructField("n_train", T.LongType())])

    def run(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        out = rows[["coin", "bucket"]].copy()
        out["prob_up"], out["n_train"] = _predict(known, rows, names, params) if len(rows) else ([], [])
        return out[[f.name for f in schema]]

    one = F.lit(1).alias("_g")
    # One pooled model: window_bars rows of each configured coin meet in one group.
    preds = now.join(enough, "coin", "left_semi").select(one, "coin", "bucket", *names).groupBy("_g").cogroup(_fresh(train.join(enough, "coin", "left_semi").select(one, "coin", "bucket", "label", *names)).groupBy("_g")).applyInPandas(run, schema)
    return preds.withColumns({"action": action(F.col("prob_up"), buy, sell), "model_version": version_name(freq, horizon_bars, F.col("bucket"))})


def stale_signals(signals: DataFrame, now: str, bar_seconds: int) -> DataFrame:
    """Signals whose bar lies more than two bars back."""
    return signals.where(F.col("bucket") < F.lit(now).cast(signals.schema["bucket"].dataType) - F.expr(f"interval {2 * bar_seconds} seconds"))


def tune(frames: dict[str, tuple[DataFrame, list[str]]], candidates: list[dict], choose: tuple[str, str], confirm: tuple[str, str], seconds: dict[str, int], horizon_bars: int, retrain_every: int, history_days: int, params: dict, fee_bps: float) -> tuple[DataFrame, DataFrame]:
    """Results of every candidate over the older period, and those of the best one over the newer: by return of the portfolio,
    then by fewer trades. All learn from as many days."""

    def results(period: tuple[str, str], which: list[tuple[int, dict]]) -> DataFrame:
        out = None
        for i, c in which:
            frame, names = frames[c["freq"]]
            bar = seconds[c["freq"]]
            preds = walk_forward(frame, names, *period, bar, horizon_bars, max(1, retrain_every * 3600 // bar), history_days * 86400 // bar, params, c["buy_threshold"], c["sell_threshold"])
            m = evaluate(preds, fee_bps)[1].where(F.col("coin").startswith("ALL")).withColumns({"candidate": F.lit(i), "freq": F.lit(c["freq"]), "buy_threshold": F.lit(c["buy_threshold"]), "sell_threshold": F.lit(c["sell_threshold"])})
            out = m if out is None else out.unionByName(m)
        return out

    chosen = results(choose, list(enumerate(candidates)))
    best = best_candidate(chosen.where(F.col("variant") == VARIANTS[0])).first()
    return chosen, results(confirm, [(best["candidate"], candidates[best["candidate"]])])
