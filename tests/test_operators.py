"""Operators on small made-up inputs, with values worked out by hand."""

import math
from datetime import UTC, date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid import config
from tidegrid.operators import bars, events, features, gbdt, health, islands, joins, kernels, lagstats, models, trading, validate

T0 = datetime(2024, 1, 1)
h = lambda n: T0 + timedelta(hours=n)
m = lambda n: T0 + timedelta(minutes=n)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_minute_returns_and_bars(spark):
    c = frame(spark, [(m(0), "A", 1.0, 2.0, 0.5, 1.0, 5.0), (m(1), "A", 1.0, 3.0, 1.0, 2.0, 5.0), (m(3), "A", 2.0, 2.0, 2.0, 4.0, 5.0), (m(61), "A", 9.0, 9.0, 9.0, 9.0, 1.0)], "time timestamp_ntz, symbol string, open double, high double, low double, close double, volume double")
    r = {x.time: x.r1m for x in bars.with_minute_returns(c).collect()}
    assert r[m(0)] is None and r[m(3)] is None and math.isclose(r[m(1)], math.log(2))
    b = bars.market_bars(bars.with_minute_returns(c), 3600).orderBy("bucket").collect()
    assert [(x.open, x.high, x.low, x.close, x.volume, x.n_candles) for x in b] == [(1, 3, 0.5, 4, 15, 3), (9, 9, 9, 9, 1, 1)]
    assert math.isclose(b[0].realized_vol, math.log(2)) and b[1].realized_vol is None


def test_features_contract(spark):
    cols = features.feature_columns(("btc",))
    assert len(cols) == 31 and cols[-3:] == ("btc_news_score", "btc_news_count", "btc_news_roll")
    assert features.feature_schema(("btc",))["btc_news_count"].dataType.typeName() == "integer"
    c = frame(spark, [(m(i), s, 1.0, 1.0, 1.0, 1.0 + i, 1.0) for s in ("BTCUSDT", "SOLUSDT") for i in (*range(120), *range(180, 240), 240)], "time timestamp_ntz, symbol string, open double, high double, low double, close double, volume double")
    s = frame(spark, [(m(5), "u1", "BTC/USDT", 0.6, 0.1, "positive"), (m(200), "u1", "BTC/USDT", -0.9, 0.1, "negative"), (m(190), "u2", "BTC/USDT", -0.6, 0.1, "negative")], "time timestamp_ntz, url string, coin string, finbert_compound double, vader_compound double, finbert_label string")
    f = features.build_features(c, s, ("1h", "4h"), 6, 24, {"BTCUSDT": "BTC/USDT", "SOLUSDT": "SOL/USDT"}, {"btc": "BTC/USDT"})
    rows = f.where("freq = '1h'").orderBy("symbol", "bucket").collect()
    # Four bars each: the unfinished last one is gone, the empty one is there.
    assert len(rows) == 8 and tuple(f.columns) == cols
    assert [r.n_candles for r in rows[:4]] == [60, 60, 0, 60] and [r.is_complete for r in rows[:4]] == [True, True, False, True]
    assert rows[2].close is None and rows[3].log_return is None and rows[1].log_return is not None
    assert [r.btc_news_score for r in rows[4:]] == [0.6, 0.0, 0.0, -0.6] and [r.n_articles for r in rows[4:]] == [0, 0, 0, 0]
    assert math.isclose(rows[7].btc_news_roll, 0.0, abs_tol=1e-12) and rows[4].coin == "SOL/USDT"


def test_plan_run():
    cfg = config.parse_feature_config({"frequencies": ["1h", "4h"], "rolling_short_bars": 6, "rolling_long_bars": 24, "incremental_lookback_bars": 6, "table": "features_bar", "news_streams": {"btc": "BTC/USDT"}}, [{"symbol": "BTC/USDT"}])
    assert features.plan_run(cfg, {}, False).mode == "full" and features.plan_run(cfg, {"1h": T0, "4h": T0}, True).mode == "full"
    p = features.plan_run(cfg, {"1h": h(100), "4h": h(96)}, False)
    assert p.mode == "incremental" and p.write_from == h(96 - 24) and p.read_from == h(96 - 24 - 100)
    p = features.plan_run(cfg, {}, False, start=h(10), end=h(20))
    assert (p.mode, p.write_from, p.read_end) == ("pinned", h(10), h(20))
    for bad in ({"frequencies": ["2h"]}, {"rolling_short_bars": 24}, {"table": "a b"}):
        with pytest.raises(ValueError):
            config.parse_feature_config({"frequencies": ["1h"], "rolling_short_bars": 6, "rolling_long_bars": 24, "incremental_lookback_bars": 6, "table": "t", "news_streams": {}} | bad, [])
    with pytest.raises(KeyError):
        config.parse_feature_config({}, [])


def test_config_sections(tmp_path):
    s = {"targets": ["SOL/USDT"], "input_coins": ["BTC/USDT"], "freq": "1h", "per_freq": {"4h": {"train_window_bars": 360, "min_train_bars": 120, "model": {"max_depth": 2}}}, "horizon_bars": 1, "buy_threshold": 0.55, "sell_threshold": 0.45, "train_window_bars": 2160, "min_train_bars": 500, "table": "signals", "model": {"max_depth": 3, "max_iter": 200}}
    assert config.parse_signal_config(s).bar() == timedelta(hours=1)
    four = config.parse_signal_config(s, "4h")
    assert four.train_window_bars == 360 and four.model == {"max_depth": 2, "max_iter": 200} and four.horizon() == timedelta(hours=4)
    with pytest.raises(KeyError):
        config.parse_signal_config(s, "1d")
    with pytest.raises(ValueError):
        config.parse_signal_config(s | {"per_freq": {"4h": {"train_window_bars": 1, "min_train_bars": 1, "targets": []}}}, "4h")
    with pytest.raises(ValueError):
        config.parse_signal_config(s | {"input_coins": ["SOL/USDT"]})
    with pytest.raises(ValueError):
        config.parse_backtest_config({"test_days": 0, "retrain_every_bars": 24, "fee_bps": 10})
    assert config.parse_tuning_config({"choose_days": 30, "confirm_days": 30, "candidates": [{"freq": "1h", "buy_threshold": 0.55, "sell_threshold": 0.45}]}).candidates
    assert config.parse_maintenance_config({"history_start": "2026-06-01", "min_articles_per_day": 1, "news_backfill_coins": [], "retag_source_types": [], "kafka_max_lag": 1000, "stale_minutes": {"market": 5, "news": 60, "scoring": 60, "signals": 90}}).history_start == date(2026, 6, 1)
    e = {"cause_coins": ["BTC/USDT"], "price_targets": ["BTC/USDT"], "sentiment_column": "finbert_compound", "threshold": 0.6, "cluster_window_hours": 2.0, "horizon_hours": 48, "n_baseline_samples": 2000, "n_bootstrap": 1000, "min_events": 15, "significance": 0.05, "onset_min_run": 2, "min_effect_car": 0.01}
    assert config.parse_event_study_config(e).horizon_hours == 48
    with pytest.raises(ValueError):
        config.parse_event_study_config(e | {"sentiment_column": "x"})
    lag = {"frequencies": ["1h"], "max_lag": 24, "sentiment_column": "finbert_compound", "fill_method": "zero", "target": "log_return", "significance": 0.05, "min_coverage_warn": 0.2, "rolling": {"enabled": True, "window_bars": 168, "step_bars": 24, "min_coverage": 0.2}}
    assert config.parse_lag_config(lag).max_lag == 24
    with pytest.raises(ValueError):
        config.parse_lag_config(lag | {"fill_method": "x"})
    assert config.to_utc("2024-01-01") == datetime(2024, 1, 1, tzinfo=UTC) and config.to_utc(date(2024, 1, 1)).hour == 0 and config.to_utc(None) is None
    assert config.to_pair("solusdt") == "SOL/USDT" and config.age_text(90) == "1.5 h" and config.coin_key("BTC/USDT") == "btc"
    (tmp_path / "c.yaml").write_text("a: ${X:-7}\nb: ${Y}\n")
    assert config.load(str(tmp_path / "c.yaml"), {"Y": "z"}) == {"a": 7, "b": "z"}
    with pytest.raises(ValueError):
        config.validate_request(freq="2h")


def test_islands(spark):
    r = frame(spark, [("A", h(i), i in (1, 2, 3, 6, 7)) for i in range(9)], "symbol string, t timestamp_ntz, c boolean")
    got = islands.runs_where(r, ["symbol"], "t", F.col("c"))
    assert [(x.start, x.end, x.n) for x in got.orderBy("start").collect()] == [(h(1), h(3), 3), (h(6), h(7), 2)]
    assert islands.longest_run(got, ["symbol"]).first().n == 3 and islands.first_run(got, ["symbol"], 2).first().onset == h(1)
    gaps = islands.all_gaps(frame(spark, [("A", m(2)), ("A", m(3)), ("A", m(7))], "symbol string, t timestamp_ntz"), ["symbol"], "t", 60, F.lit(m(0)).cast("timestamp_ntz"), F.lit(m(10)).cast("timestamp_ntz"))
    assert [(x.start, x.end, x.n) for x in gaps.orderBy("start").collect()] == [(m(0), m(2), 2), (m(4), m(7), 3), (m(8), m(10), 2)]
    # Nested ranges, and one exactly `within` apart, which stays apart.
    ranges = frame(spark, [("A", m(0), m(100)), ("A", m(10), m(20)), ("A", m(105), m(110)), ("A", m(120), m(130))], "symbol string, start timestamp_ntz, end timestamp_ntz")
    assert [(x.start, x.end) for x in islands.join_ranges(ranges, ["symbol"], 600).orderBy("start").collect()] == [(m(0), m(110)), (m(120), m(130))]
    c = islands.clusters(frame(spark, [("A", m(0)), ("A", m(120)), ("A", m(241))], "coin string, time timestamp_ntz"), ["coin"], "time", 7200)
    assert [x.cluster for x in c.orderBy("time").collect()] == [1, 1, 2]


@pytest.mark.parametrize("chunk", [None, 3600, 86400])
def test_as_of_equals_brute_force(spark, chunk):
    rng = np.random.default_rng(1)
    right = [("AB"[k % 2], m(int(t)), float(k)) for k, t in enumerate(sorted(rng.choice(5000, 40, replace=False)))]
    left = [(i, "ABC"[i % 3], m(int(t))) for i, t in enumerate(rng.integers(-100, 6000, 90))] + [(99, "A", right[0][1])]
    got = joins.as_of(frame(spark, left, "id int, s string, t timestamp_ntz"), frame(spark, right, "s string, rt timestamp_ntz, v double"), ["s"], "t", "rt", ["v"], chunk).collect()
    want = {i: max(((rt, v) for rs, rt, v in right if rs == s and rt <= t), default=(None, None))[1] for i, s, t in left}
    assert {r.id: r.v for r in got} == want and len(got) == len(left)


def test_lag_statistics(spark):
    rng = np.random.default_rng(3)
    n, x = 700, rng.standard_normal(700)
    y = np.concatenate([np.zeros(3), 0.6 * x[:-3]]) + 0.5 * rng.standard_normal(n)
    df = frame(spark, [("A", h(i), float(x[i]), float(y[i]) if i not in (50, 51) else None, 1) for i in range(n)] + [("B", h(i), 1.0, float(i), 1) for i in range(40)], "s string, t timestamp_ntz, a double, b double, n_articles int")
    ccf = lagstats.cross_correlation(df, ["s"], "t", "a", "b", 8)
    assert lagstats.peak_lag(ccf, ["s"]).where("s = 'A'").first().lag == 3
    row = ccf.where("s = 'A' and lag = 3").first()
    keep = [i for i in range(3, n) if i not in (50, 51)]
    assert row.n == len(keep) and math.isclose(row["corr"], np.corrcoef(x[[i - 3 for i in keep]], y[keep])[0, 1], rel_tol=1e-9) and row.significant
    assert {r["corr"] for r in ccf.where("s = 'B'").collect()} == {None}
    g = kernels.granger(df, ["s"], "t", "a", "b", 6).where("s = 'A'").orderBy("lag").collect()
    assert g[2].p < 1e-10 and g[2].p_fdr < 1e-9 and sum(r.chosen for r in g) == 1 and next(r.lag for r in g if r.chosen) == 3
    back = kernels.granger(df, ["s"], "t", "b", "a", 6).where("s = 'A'").collect()
    assert min(r.p_fdr for r in back) > 0.01
    p = frame(spark, [(1, 0.01), (2, 0.04), (3, 0.03), (4, 0.005), (5, None)], "i int, p double").withColumn("k", F.lit("x"))
    assert [round(r.p_fdr, 4) if r.p_fdr else None for r in lagstats.benjamini_hochberg(p, ["k"], "p", "i").orderBy("i").collect()] == [0.02, 0.04, 0.04, 0.02, None]
    assert lagstats.reduced_lag(24, 60) == 12


def test_stationarity_kernels():
    rng = np.random.default_rng(5)
    noise, walk = rng.standard_normal(500), np.cumsum(rng.standard_normal(500))
    assert kernels.verdict(noise)["verdict"] == "stationary" and kernels.verdict(walk)["verdict"] == "non-stationary"
    assert kernels.verdict(np.ones(50))["verdict"] == "constant" and kernels.verdict(noise[:10])["verdict"] == "too_short"
    assert math.isclose(kernels.f_tail(4.0, 2, 20), (1 + 2 * 4 / 20) ** -10, rel_tol=1e-10)
    assert np.allclose(kernels.fdr(np.array([0.01, 0.04, 0.03, 0.005])), [0.02, 0.04, 0.04, 0.02])


def test_event_study(spark):
    s = frame(spark, [(m(0), "u1", "A", 0.9), (m(45), "u2", "A", 0.7), (m(50), "u1", "A", 0.9), (m(60), "u3", "A", 0.1), (h(24), "u4", "A", -0.8), (h(40), "u5", "A", 0.6), (h(41), "u6", "A", -0.6)], "time timestamp_ntz, url string, coin string, finbert_compound double")
    e = events.cluster_events(events.strong_articles(s, "finbert_compound", 0.6), 2)
    assert [(r.event_time, r.direction, round(r.magnitude, 3), r.n_articles) for r in e.orderBy("event_time").collect()] == [(m(0), "positive", 0.8, 2), (h(24), "negative", 0.8, 1), (h(40), "negative", 0.6, 2)]
    with pytest.raises(ValueError):
        events.strong_articles(s, "x; drop", 0.6)
    closes = frame(spark, [("A", h(i), None if i == 26 else 100.0 * (1.05 if i >= 3 else 1.0)) for i in range(30)], "symbol string, bucket timestamp_ntz, close double")
    car = events.event_car(e.withColumn("symbol", F.col("coin")), closes, 5)
    first = {r.h: r.car for r in car.where(F.col("event_time") == F.lit(m(0)).cast("timestamp_ntz")).collect()}
    assert math.isclose(first[2], 0, abs_tol=1e-12) and math.isclose(first[3], math.log(1.05)) and len(first) == 5
    second = {r.h: r.car for r in car.where(F.col("event_time") == F.lit(h(24)).cast("timestamp_ntz")).collect()}
    assert second[2] is None and second[3] == 0.0
    assert all(r.car is None for r in car.where(F.col("event_time") == F.lit(h(40)).cast("timestamp_ntz")).collect())
    best = events.optimal_exit(car, ["coin", "event_time"]).where("direction = 'positive'").first()
    assert best.exit_h == 3
    assert events.exit_distribution(frame(spark, [("p", x) for x in (1, 2, 4, 10)], "direction string, exit_h int"), ["direction"]).first()[1:4] == (4, 1.75, 3.0)


def test_planted_event_effect_is_found(spark):
    rng = np.random.default_rng(8)
    n, price = 1500, 100.0
    steps, times = 0.002 * rng.standard_normal(n), list(range(30, n - 60, 30))
    for t in times:
        steps[t + 3] += 0.05
    close = price * np.exp(np.cumsum(steps))
    scores = frame(spark, [(h(t), f"u{t}", "A", 0.9) for t in times], "time timestamp_ntz, url string, coin string, finbert_compound double")
    closes = frame(spark, [("A", h(i), float(c)) for i, c in enumerate(close)], "symbol string, bucket timestamp_ntz, close double")
    out = events.study(scores, closes, ["A"], "finbert_compound", 0.6, 2, 8, 400, 300, 15, 0.05, 2, 0.01)
    assert out["onset"].first().onset in (3, 4, 5)
    assert out["exits"].first().n == len(times)


def test_trading_rules(spark):
    acts = ["HOLD", "BUY", "HOLD", "SELL", "HOLD", "BUY"]
    p = frame(spark, [("v", "c", h(i), a, 0.6, 1.0 if i % 2 else 0.0, 0.01) for i, a in enumerate(acts)], "variant string, coin string, bucket timestamp_ntz, action string, prob_up double, label double, next_return double")
    t = trading.strategy_returns(p, ["variant", "coin"], 10).orderBy("bucket").collect()
    assert [r.position for r in t] == [0, 1, 1, 0, 0, 1] and [r.trade for r in t] == [False, True, False, True, False, True]
    assert [round(r.strategy_return, 6) for r in t] == [0, 0.009, 0.01, -0.001, 0, 0.009]
    x = frame(spark, [("a", 0.1, 0.0), ("a", 0.4, 0.0), ("a", 0.4, 1.0), ("a", 0.8, 1.0), ("b", 0.5, 1.0)], "k string, s double, y double")
    assert {r.k: r.auc for r in trading.auc(x, ["k"], "y", "s").collect()} == {"a": 0.875, "b": None}
    m_ = trading.evaluate(p, 10)[1].collect()
    assert {r.coin for r in m_} == {"c", trading.PORTFOLIO} and all(r.trades == 3 for r in m_)
    # A first loss is no drawdown: the first peak is the equity after it.
    d = trading.equity(frame(spark, [("k", h(0), -0.5), ("k", h(1), 0.1), ("k", h(2), -0.2)], "k string, bucket timestamp_ntz, r double"), ["k"], "r", "d")
    assert [round(r.d, 6) for r in d.orderBy("bucket").collect()] == [0, 0, -0.2]
    c = frame(spark, [(0, 1.0, 5), (1, 1.0, 3), (2, None, 0)], "candidate int, strategy_return double, trades int")
    assert trading.best_candidate(c).first().candidate == 1


def planted(spark, n, strength, seed=0):
    rng = np.random.default_rng(seed)
    news = rng.standard_normal(n)
    up = np.where(rng.random(n) < strength, news > 0, rng.random(n) > 0.5)
    rows = [("X", h(i), float(news[i]) if rng.random() > 0.1 else None, float(rng.standard_normal()), float(up[i]), 100.0 + i) for i in range(n)]
    return frame(spark, rows, "coin string, bucket timestamp_ntz, btc_news_score double, other double, label double, close double")


def test_walk_forward_finds_a_planted_pattern_and_nothing_in_noise(spark):
    params = {"max_iter": 30, "learning_rate": 0.1, "max_depth": 2, "min_samples_leaf": 20}
    for strength, low, high in ((0.9, 0.75, 1.0), (0.0, 0.38, 0.62)):
        preds = models.walk_forward(planted(spark, 900, strength), ["btc_news_score", "other"], str(h(500)), str(h(860)), 3600, 1, 60, 400, params, 0.55, 0.45)
        a = {r.variant: r.auc for r in trading.auc(preds, ["variant"], "label", "prob_up").collect()}
        assert low <= a["price+news"] <= high and 0.38 <= a["price_only"] <= 0.62
        # No row that was known only later teaches, and no more than the window.
        assert preds.agg(F.max("n_train")).first()[0] <= 400
        first = preds.where(F.col("bucket") == F.lit(h(500)).cast("timestamp_ntz")).first()
        assert first.n_train == 400


def test_walk_forward_does_not_look_ahead(spark):
    params = {"max_iter": 5, "learning_rate": 0.1, "max_depth": 2, "min_samples_leaf": 20}
    f = planted(spark, 300, 0.5)
    later = f.withColumn("label", F.when(F.col("bucket") >= F.lit(h(250)).cast("timestamp_ntz"), 1 - F.col("label")).otherwise(F.col("label")))
    run = lambda x: {r.bucket: r.prob_up for r in models.walk_forward(x, ["btc_news_score", "other"], str(h(200)), str(h(251)), 3600, 1, 10, 100, params, 0.55, 0.45).where("variant = 'price+news'").collect()}
    assert run(f) == run(later)


def test_booster():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    x[rng.random(800) < 0.05, 2] = np.nan
    b = gbdt.Booster(max_iter=60, learning_rate=0.2, min_samples_leaf=10).fit(x, y)
    assert ((b.predict(x) > 0.5) == (y == 1)).mean() > 0.95
    miss = x.copy()
    miss[:, 0] = np.where(y == 1, np.nan, x[:, 0])
    assert ((gbdt.Booster(max_iter=20, min_samples_leaf=10).fit(miss, y).predict(miss) > 0.5) == (y == 1)).mean() > 0.99
    assert gbdt.Booster().fit(x, np.ones(800)).predict(x[:2]).tolist() == [1.0, 1.0] and gbdt.Booster().fit(x[:0], y[:0]).predict(x[:1])[0] == 0.5


def test_validation_reasons(spark):
    import json

    ok = {"symbol": "BTCUSDT", "exchange": "x", "kline_start_time": 60000, "kline_close_time": 119999, "open": 1, "high": 3, "low": 0.5, "close": 2, "volume": 0, "is_closed": True}
    cases = [(ok, None), (ok | {"open": "1.5"}, None), (ok | {"is_closed": False}, "open"), ({k: v for k, v in ok.items() if k != "is_closed"}, "open"), (ok | {"open": 0}, "price not positive"), (ok | {"close": "abc"}, "not a finite number"), (ok | {"close": "NaN"}, "not a finite number"), (ok | {"close": "Infinity"}, "not a finite number"), (ok | {"volume": -1}, "negative volume"), (ok | {"open": True}, "not a finite number"), ({k: v for k, v in ok.items() if k != "low"}, "missing field"), (ok | {"low": None}, "missing field"), (ok | {"high": 1}, "high too low"), (ok | {"low": 1.5}, "low too high"), (ok | {"kline_close_time": 60000}, "close not after start"), (ok | {"kline_start_time": "x"}, "bad time")]
    rows = [(json.dumps(c), r) for c, r in cases] + [("nope", "malformed"), ("[1]", "malformed"), ("", "malformed"), (None, "malformed")]
    got = {r.value: r.reason for r in validate.candles(frame(spark, [(v,) for v, _ in rows], "value string")).collect()}
    assert got == dict(rows)
    a = {"source_type": "rss", "source_name": "s", "title": "t", "url": "u", "published_at": "2024-02-05T10:30:00+02:00", "coin_tags": ["BTC/USDT"]}
    rows = [(json.dumps(a), None), (json.dumps(a | {"title": ""}), "missing field"), (json.dumps(a | {"coin_tags": "BTC"}), "tags are no list"), (json.dumps(a | {"published_at": "soon"}), "bad date"), ("null", "malformed")]
    got = {r.value: r for r in validate.articles(frame(spark, [(v,) for v, _ in rows], "value string")).collect()}
    assert {v: r.reason for v, r in got.items()} == dict(rows)
    assert got[rows[0][0]].summary == "" and got[rows[0][0]].coin_tags == ["BTC/USDT"]


def test_health(spark):
    out = health.guarded(spark, {"a": lambda: frame(spark, [("a", "c", "WARN", "d", 1, "u", "market")], health.FINDING), "b": lambda: 1 / 0})
    assert {(r.area, r.status) for r in out.collect()} == {("a", "WARN"), ("b", "FAIL")} and health.summary(out).first().worst == "FAIL"
    assert health.repair_plan([{"status": "FAIL", "action": "market"}]) == ["market", "features", "signals"]
    assert health.repair_plan([{"status": "WARN", "action": "news"}], with_news=False) == []
    assert health.run_repairs(["market", "features"], {"market": lambda: 1 / 0, "features": lambda: None})[1] == ("features", "skipped")
    assert health.progress_lag([{"sources": [{"endOffset": {"t": {"0": 5}}, "latestOffset": {"t": {"0": 9, "1": 2}}}]}]) == 6


def test_volumes_of_any_size_add_up(spark):
    rows = [("A", f"2024-01-01 00:{m:02d}:00", 1.0, 1.0, 1.0, 1.0, 0.00004) for m in range(15)] + [("B", "2024-01-01 00:00:00", 1.0, 1.0, 1.0, 1.0, 3e14)]
    c = frame(spark, rows, "symbol string, time string, open double, high double, low double, close double, volume double").withColumn("time", F.to_timestamp_ntz("time"))
    got = {r.symbol: r.volume for r in bars.market_bars(bars.with_minute_returns(c), 900).collect()}
    assert got["A"] == pytest.approx(0.0006) and got["B"] == 3e14


def test_granger_p_counts_both_equations():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal(80), rng.standard_normal(80)
    f, p = kernels.granger_f(x, y, 2)
    assert p == pytest.approx(kernels.f_tail(f, 2, 2 * (78 - 5)))


def test_verdicts_follow_both_tests(monkeypatch):
    x = np.arange(40.0)
    for adf_p, kpss_p, name in ((0.01, 0.1, "stationary"), (0.01, 0.05, "inconclusive"), (0.5, 0.1, "inconclusive"), (0.05, 0.05, "non-stationary")):
        monkeypatch.setattr(kernels, "adf", lambda v, p=adf_p: (0.0, p, 0))
        monkeypatch.setattr(kernels, "kpss", lambda v, p=kpss_p: (0.0, p, 0))
        assert kernels.verdict(x, 0.05)["verdict"] == name
