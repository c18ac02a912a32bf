"""Whole jobs over stores of candles, scores, features and signals: what a command line or a scheduler calls.

Stores are sources.sinks.KeyedStore tables; frames have the columns of the package's data model. Every job takes its
period and options as arguments and leaves its results in a store or under a report path.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import FREQ_SECONDS, BacktestConfig, EventStudyConfig, LagConfig, MaintenanceConfig, SignalConfig, TuningConfig, coin_to_symbol, expected_candles, validate_request
from .functions.columns import bucket
from .operators import bars, events, health, kernels, lagstats, models, trading
from .operators.joins import missing_pairs
from .sources.readers import between
from .sources.sinks import KeyedStore, write_report


def resolve_window(candles: DataFrame, coin: str, start: datetime | None = None, end: datetime | None = None) -> tuple[datetime, datetime, str]:
    """[start, end) of a coin's candles and how it came about: pinned (both told), partly pinned, or auto. The end of what there
    is lies a minute after the last candle, so that it is within. ValueError without candles."""
    if start is not None and end is not None:
        return start, end, "pinned"
    first, last = candles.where(F.col("symbol") == coin_to_symbol(coin)).agg(F.min("time"), F.max("time")).first()
    if first is None:
        raise ValueError(f"no candles of {coin}")
    mode = "auto" if start is None and end is None else "partly pinned"
    return (first if start is None else start), (last + timedelta(minutes=1) if end is None else end), mode


def sentiment_series(scores: DataFrame, coin: str, freq: str, column: str) -> DataFrame:
    """symbol, bucket, sent_mean, sent_sum, n_articles of a coin, each url once."""
    mine = bars.earliest(scores.where(F.col("coin") == coin), ["coin", "url"], ["time", column])
    return mine.groupBy(F.lit(coin_to_symbol(coin)).alias("symbol"), bucket("time", FREQ_SECONDS[freq]).alias("bucket")).agg(F.avg(column).alias("sent_mean"), F.sum(column).alias("sent_sum"), F.count("*").alias("n_articles"))


def build_dataset(candles: DataFrame, scores: DataFrame, cfg: LagConfig, coin: str, freq: str, start: datetime | None = None, end: datetime | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """The aligned series of a coin at a frequency, its diagnostics, and the window they are of."""
    validate_request(freq=freq)
    a, b, mode = resolve_window(candles, coin, start, end)
    market = bars.last_close(between(candles.where(F.col("symbol") == coin_to_symbol(coin)), a, b), FREQ_SECONDS[freq])
    df = lagstats.aligned(market, sentiment_series(between(scores, a, b), coin, freq, cfg.sentiment_column), FREQ_SECONDS[freq], expected_candles(freq), cfg.fill_method)
    return df, lagstats.diagnostics(df, expected_candles(freq)), {"start": a, "end": b, "window": mode}


def lag_report(candles: DataFrame, scores: DataFrame, cfg: LagConfig, coin: str, freq: str, start: datetime | None = None, end: datetime | None = None, path: str | None = None) -> dict | None:
    """Diagnostics, cross-correlations, Granger tests both ways and the rolling scan; None for a coin without articles.

    The series is made stationary first; lags are cut where there are too few valid bars. With a path, tables and a summary are written there.
    """
    df, found, window = build_dataset(candles, scores, cfg, coin, freq, start, end)
    d = found.first()
    if d is None or not d.coverage:
        return None
    lag = lagstats.reduced_lag(cfg.max_lag, d.n_valid)
    series = kernels.make_stationary(df.select("symbol", "bucket", "n_articles", "sentiment", cfg.target), ["symbol"], "bucket", ["sentiment", cfg.target], cfg.significance)
    ccf = lagstats.cross_correlation(series, ["symbol"], "bucket", "sentiment", cfg.target, lag, cfg.significance)
    tables = {
        "series": df.drop("gaps"), "ccf": ccf, "peak_lead": lagstats.peak_lag(ccf, ["symbol"]), "peak_lag": lagstats.peak_lag(ccf, ["symbol"], False),
        "stationarity": kernels.stationarity(df, ["symbol"], "bucket", cfg.target, cfg.significance),
        "granger_news_to_price": kernels.granger(series, ["symbol"], "bucket", "sentiment", cfg.target, lag, cfg.significance),
        "granger_price_to_news": kernels.granger(series, ["symbol"], "bucket", cfg.target, "sentiment", lag, cfg.significance),
    }
    if cfg.rolling:
        tables["rolling"] = lagstats.rolling_scan(series, ["symbol"], "bucket", "sentiment", cfg.target, cfg.window_bars, cfg.step_bars, lag, cfg.min_coverage, cfg.significance)
        tables["rolling_summary"] = lagstats.summarize_scan(tables["rolling"], ["symbol"])
    summary = {"coin": coin, "freq": freq, **window, "n_bars": d.n_bars, "n_valid": d.n_valid, "n_empty": d.n_empty, "coverage": d.coverage, "low_coverage": d.coverage < cfg.min_coverage_warn, "max_lag": lag}
    if path is not None:
        write_report(df.sparkSession, tables, summary, path)
    return {"tables": tables, "summary": summary}


def event_study(candles: DataFrame, scores: DataFrame, cfg: EventStudyConfig, start: datetime | None = None, end: datetime | None = None, path: str | None = None) -> dict[str, DataFrame]:
    """All causes and targets in one plan. Prices reach a horizon beyond the last article, so that late events have theirs."""
    after = None if end is None else end + timedelta(hours=cfg.horizon_hours)
    symbols = [coin_to_symbol(c) for c in cfg.price_targets]
    closes = bars.last_close(between(candles.where(F.col("symbol").isin(symbols)), start, after), 3600)
    out = events.study(between(scores, start, end), closes, list(cfg.cause_coins), cfg.sentiment_column, cfg.threshold, cfg.cluster_window_hours, cfg.horizon_hours, cfg.n_baseline_samples, cfg.n_bootstrap, cfg.min_events, cfg.significance, cfg.onset_min_run, cfg.min_effect_car)
    # A coin that is its own cause, or another one that its news spill over to.
    kind = F.when(F.upper(F.replace("cause", F.lit("/"), F.lit(""))) == F.col("symbol"), "own_coin").otherwise("spillover")
    out = {k: df.withColumn("kind", kind) if {"cause", "symbol"} <= set(df.columns) else df for k, df in out.items()}
    if path is not None:
        write_report(candles.sparkSession, out, {"causes": cfg.cause_coins, "targets": cfg.price_targets, "start": start, "end": end, "horizon_hours": cfg.horizon_hours}, path)
    return out


def signals(features: DataFrame, cfg: SignalConfig, store: KeyedStore | None = None) -> DataFrame:
    """A signal for each target's latest priced bar; with a store, put there."""
    frame, names = trading.model_frame(features, cfg.targets, cfg.input_coins, cfg.horizon_bars)
    out = models.generate_signals(frame, names, cfg.freq, FREQ_SECONDS[cfg.freq], cfg.horizon_bars, cfg.train_window_bars, cfg.min_train_bars, cfg.model, cfg.buy_threshold, cfg.sell_threshold)
    out = out.select(F.upper(F.replace("coin", F.lit("/"), F.lit(""))).alias("symbol"), F.lit(cfg.freq).alias("freq"), "bucket", "coin", "prob_up", "action", "n_train", "model_version")
    if store is not None:
        store.upsert(out)
    return out


def replay(features: DataFrame, cfg: SignalConfig, store: KeyedStore, start: datetime, end: datetime, dry_run: bool = False, compare_live: bool = False) -> DataFrame:
    """Signals as they would have been at each bar of [start, end) that lacks one, by models that know no more than was known then.

    Replayed signals are marked so in their version and never take a live one's place. compare_live: instead, how those that
    a replay gives for bars with live signals differ from them.
    """
    frame, names = trading.model_frame(features, cfg.targets, cfg.input_coins, cfg.horizon_bars)
    span = between(frame, start, end, "bucket")
    have = store.read().where(F.col("freq") == cfg.freq)
    times = span.select("bucket").distinct() if compare_live else missing_pairs(span, "bucket", [coin_to_symbol(c) for c in cfg.targets], "symbol", have)
    preds = models.predict_at(frame, names, times, FREQ_SECONDS[cfg.freq], cfg.horizon_bars, cfg.train_window_bars, cfg.min_train_bars, cfg.model, cfg.buy_threshold, cfg.sell_threshold)
    out = preds.select(F.upper(F.replace("coin", F.lit("/"), F.lit(""))).alias("symbol"), F.lit(cfg.freq).alias("freq"), "bucket", "coin", "prob_up", "action", "n_train", F.concat(F.lit(f"replay:gbt-{cfg.freq}-h{cfg.horizon_bars}-"), F.date_format("bucket", "yyyyMMdd'T'HHmm")).alias("model_version"))
    if compare_live:
        return trading.compare_signals(have.where(~F.col("model_version").startswith("replay:")), out)
    if not dry_run:
        store.insert_if_absent(out, ["model_version"])
    return out


def backtest_period(features: DataFrame, days: int, start: datetime | None = None, end: datetime | None = None) -> tuple[datetime, datetime]:
    """[start, end) as told, or the last days there are."""
    if end is None:
        end = features.where(F.col("close").isNotNull()).agg(F.max("bucket")).first()[0]
        if end is None:
            raise ValueError("no priced bars")
    return (end - timedelta(days=days) if start is None else start), end


def backtest(features: DataFrame, cfg: SignalConfig, test: BacktestConfig, start: datetime | None = None, end: datetime | None = None, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Trading rows and metrics of a walk-forward test; with a path, written there."""
    a, b = backtest_period(features, test.test_days, start, end)
    frame, names = trading.model_frame(features, cfg.targets, cfg.input_coins, cfg.horizon_bars)
    preds = models.walk_forward(frame, names, str(a), str(b), FREQ_SECONDS[cfg.freq], cfg.horizon_bars, test.retrain_every_bars, cfg.train_window_bars, cfg.model, cfg.buy_threshold, cfg.sell_threshold)
    traded, metrics = trading.evaluate(preds, test.fee_bps)
    if path is not None:
        write_report(features.sparkSession, {"trades": traded, "summary": trading.in_report_order(metrics)}, {"start": a, "end": b, "freq": cfg.freq, "retrain_every_bars": test.retrain_every_bars, "fee_bps": test.fee_bps}, path)
    return traded, metrics


def tuning(features: dict[str, DataFrame], cfg: SignalConfig, test: BacktestConfig, tune: TuningConfig, end: datetime, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Candidates over the older days, the best of them over the newer. All learn from as many days as the base frequency's window has."""
    middle = end - timedelta(days=tune.confirm_days)
    first = middle - timedelta(days=tune.choose_days)
    frames = {f: trading.model_frame(df, cfg.targets, cfg.input_coins, cfg.horizon_bars) for f, df in features.items()}
    days = cfg.train_window_bars * FREQ_SECONDS[cfg.freq] // 86400
    chosen, confirmed = models.tune(frames, list(tune.candidates), (str(first), str(middle)), (str(middle), str(end)), FREQ_SECONDS, cfg.horizon_bars, test.retrain_every_bars, days, cfg.model, test.fee_bps)
    if path is not None:
        write_report(next(iter(features.values())).sparkSession, {"choose": chosen, "confirm": confirmed}, {"choose": [first, middle], "confirm": [middle, end]}, path)
    return chosen, confirmed


def health_check(spark: SparkSession, cfg: MaintenanceConfig, candles: DataFrame, articles: DataFrame, scores: DataFrame, signal_rows: DataFrame, now: datetime, since: datetime | None = None, check_only: bool = True, with_news: bool = False, with_reports: bool = False, skip_market: bool = False, tools: dict[str, Callable[[], object]] | None = None) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Findings of the data's state, and what was repaired: nothing with check_only, else what the findings call for, in order."""
    start = since or datetime.combine(cfg.history_start, datetime.min.time())

    def fresh(area: str, table: DataFrame, time: str, action: str) -> Callable[[], DataFrame]:
        def run() -> DataFrame:
            r = health.recency(table.withColumn("_k", F.lit(area)), time, ["_k"], str(now), cfg.stale_minutes[area])
            return r.select(F.lit(area).alias("area"), F.lit("recency").alias("check"), "status", F.concat(F.col("minutes").cast("string"), F.lit(" min")).alias("detail"), F.lit(0).cast("long").alias("pending"), F.lit("").alias("unit"), F.lit(action).alias("action"))

        return run

    def backlog() -> DataFrame:
        n = health.backlog(articles, scores).agg(F.count("*").alias("pending"))
        return n.select(F.lit("scoring").alias("area"), F.lit("backlog").alias("check"), F.when(F.col("pending") == 0, "OK").otherwise("WARN").alias("status"), F.lit("").alias("detail"), "pending", F.lit("articles").alias("unit"), F.lit("score").alias("action"))

    checks: dict[str, Callable[[], DataFrame]] = {}
    if not skip_market:
        checks["market gaps"] = lambda: health.gap_finding(health.market_gaps(candles, str(start), str(now)), "market", "gaps", "minutes", "market", 1440)
        checks["market"] = fresh("market", candles, "time", "market")
    checks |= {"news": fresh("news", articles, "time", "news"), "scoring": backlog, "signals": fresh("signals", signal_rows, "bucket", "signals")}
    found = health.guarded(spark, checks)
    if check_only:
        return found, []
    steps = health.repair_plan([r.asDict() for r in found.collect()], with_news, with_reports)
    return found, health.run_repairs(steps, tools or {})
