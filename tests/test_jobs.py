"""Whole jobs on made-up stores."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid import config, jobs
from tidegrid.operators.features import build_features
from tidegrid.sources.readers import read_csv, read_reports
from tidegrid.sources.sinks import KeyedStore

T0 = datetime(2024, 1, 1)
h = lambda n: T0 + timedelta(hours=n)
LAG = {"frequencies": ["1h"], "max_lag": 6, "sentiment_column": "finbert_compound", "fill_method": "zero", "target": "log_return", "significance": 0.05, "min_coverage_warn": 0.2, "rolling": {"enabled": True, "window_bars": 96, "step_bars": 48, "min_coverage": 0.1}}
COINS = ("BTC/USDT", "ETH/USDT", "SOL/USDT")


@pytest.fixture(scope="module")
def world(spark):
    """Three coins, 400 hours of four candles each; news of the first move its price two hours later."""
    rng = np.random.default_rng(2)
    n, news = 400, rng.choice([-0.8, 0.0, 0.8], 400, p=[0.2, 0.6, 0.2])
    candles, scores = [], []
    for c in COINS:
        step = 0.004 * rng.standard_normal(n) + (0.02 * np.concatenate([[0, 0], news[:-2]]) if c == COINS[0] else 0)
        close = 100 * np.exp(np.cumsum(step))
        for i in range(n):
            for q in range(60):
                if q % 15 in (0, 1):
                    candles.append((h(i) + timedelta(minutes=q), c.replace("/", ""), float(close[i]), float(close[i]) * 1.001, float(close[i]) * 0.999, float(close[i]), 1.0))
    for i in range(n):
        if news[i]:
            scores.append((h(i) + timedelta(minutes=7), f"u{i}", COINS[0], float(news[i]), float(news[i]), "positive" if news[i] > 0 else "negative"))
    c = spark.createDataFrame(candles, "time timestamp_ntz, symbol string, open double, high double, low double, close double, volume double").cache()
    s = spark.createDataFrame(scores, "time timestamp_ntz, url string, coin string, finbert_compound double, vader_compound double, finbert_label string").cache()
    f = build_features(c, s, ("1h",), 6, 24, {x.replace("/", ""): x for x in COINS}, {"btc": COINS[0]}, {"1h": 8}).cache()
    return c, s, f


def test_lag_report(spark, world, tmp_path, monkeypatch):
    c, s, _ = world
    monkeypatch.setattr(jobs, "expected_candles", lambda f: 8)
    cfg = config.parse_lag_config(LAG)
    out = jobs.lag_report(c, s, cfg, COINS[0], "1h", path=f"file://{tmp_path}/lag")
    assert out["tables"]["peak_lead"].first().lag == 2 and out["summary"]["window"] == "auto" and out["summary"]["n_bars"] == 400
    assert out["tables"]["granger_news_to_price"].agg(F.min("p_fdr")).first()[0] < 1e-6
    assert read_reports(spark, f"file://{tmp_path}/lag/summary.json").first().coin == COINS[0]
    assert read_csv(spark, f"file://{tmp_path}/lag/ccf").count() == 13
    assert jobs.lag_report(c, s, cfg, COINS[1], "1h") is None
    assert jobs.resolve_window(c, COINS[0], start=h(5))[2] == "partly pinned"
    with pytest.raises(ValueError):
        jobs.resolve_window(c, "XX/USDT")


def test_event_study(world, tmp_path):
    c, s, _ = world
    cfg = config.EventStudyConfig((COINS[0],), COINS[:2], "finbert_compound", 0.6, 0.5, 6, 200, 200, 15, 0.05, 1, 0.005)
    out = jobs.event_study(c, s, cfg, h(0), h(390), f"file://{tmp_path}/ev")
    kinds = {(r.symbol, r.kind) for r in out["significance"].select("symbol", "kind").distinct().collect()}
    assert kinds == {("BTCUSDT", "own_coin"), ("ETHUSDT", "spillover")}
    assert out["onset"].where("symbol = 'BTCUSDT'").count() >= 1


def signal_config():
    return config.SignalConfig((COINS[0], COINS[2]), (COINS[1],), "1h", 1, 0.55, 0.45, 200, 50, "signals", {"max_iter": 15, "learning_rate": 0.2, "max_depth": 2, "min_samples_leaf": 10})


def test_signals_replay_and_backtest(spark, world, tmp_path):
    f, cfg = world[2], signal_config()
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("freq", T.StringType()), T.StructField("bucket", T.TimestampNTZType()), T.StructField("coin", T.StringType()), T.StructField("prob_up", T.DoubleType()), T.StructField("action", T.StringType()), T.StructField("n_train", T.LongType()), T.StructField("model_version", T.StringType())])
    store = KeyedStore(spark, f"file://{tmp_path}/sig", ["symbol", "freq", "bucket"], schema)
    live = jobs.signals(f, cfg, store).collect()
    assert {r.symbol for r in live} == {"BTCUSDT", "SOLUSDT"} and {r.n_train for r in live} == {400} and store.read().count() == 2
    assert jobs.replay(f, cfg, store, h(390), h(395), dry_run=True).count() == 10 and store.read().count() == 2
    jobs.replay(f, cfg, store, h(390), h(395))
    assert store.read().where(F.col("model_version").startswith("replay:")).count() == 10
    assert jobs.replay(f, cfg, store, h(390), h(395)).count() == 0
    same = jobs.replay(f, cfg, store, h(395), h(400), compare_live=True).first()
    assert same.n == 2 and same.agreement == 1.0 and same.mean_abs_diff < 1e-9
    test = config.BacktestConfig(3, 24, 10)
    traded, metrics = jobs.backtest(f, cfg, test, path=f"file://{tmp_path}/bt")
    assert {r.coin for r in metrics.collect()} == {COINS[0], COINS[2], "ALL (equal weight)"} and traded.count() == 2 * 2 * 72
    assert [r.coin for r in read_csv(spark, f"file://{tmp_path}/bt/summary").collect()][-1] == "ALL (equal weight)"
    tune = config.TuningConfig(2, 2, ({"freq": "1h", "buy_threshold": 0.55, "sell_threshold": 0.45}, {"freq": "1h", "buy_threshold": 0.9, "sell_threshold": 0.1}))
    chosen, confirmed = jobs.tuning({"1h": f}, cfg, test, tune, h(399))
    assert chosen.count() == 4 and confirmed.select("candidate").distinct().count() == 1


def test_health_check(spark, world):
    c, s, _ = world
    cfg = config.parse_maintenance_config({"history_start": "2024-01-01", "min_articles_per_day": 1, "news_backfill_coins": [], "retag_source_types": [], "kafka_max_lag": 1000, "stale_minutes": {"market": 5, "news": 60, "scoring": 60, "signals": 90}})
    articles = s.select("time", "url", F.array("coin").alias("coin_tags"))
    sig = spark.createDataFrame([(h(1), "A")], "bucket timestamp_ntz, symbol string")
    ran = []
    found, done = jobs.health_check(spark, cfg, c, articles, s.limit(3), sig, h(400), check_only=False, tools={k: lambda k=k: ran.append(k) for k in ("market", "score", "features", "signals")})
    assert {r.area: r.status for r in found.collect() if r.check in ("gaps", "backlog")} == {"market": "FAIL", "scoring": "WARN"}
    assert ran == ["market", "score", "features", "signals"] and all(x == "ok" for _, x in done)
    assert jobs.health_check(spark, cfg, c, articles, s, sig, h(400), skip_market=True)[1] == []
