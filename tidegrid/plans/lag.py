"""Queries on lag statistics and event studies."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import bars, events, kernels, lagstats
from .domain import candles, query, scores


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def _series(spark, sf):
    market = bars.last_close(candles(spark, sf), 3600)
    s = bars.dedup_articles(scores(spark, sf))
    from ..functions.columns import bucket

    sent = s.groupBy(F.col("coin").alias("symbol"), bucket("time", 3600).alias("bucket")).agg(F.avg("finbert_compound").alias("sent_mean"), F.sum("finbert_compound").alias("sent_sum"), F.count("*").alias("n_articles"))
    return lagstats.aligned(market, sent, 3600, 0)


@query("aligned_series", "SELECT symbol, bucket, close, n_articles, round(sentiment, 8) AS sentiment, round(log_return, 8) AS log_return FROM series", "series")
def aligned_series(spark, sf):
    return _r(_series(spark, sf).select("symbol", "bucket", "close", "n_articles", "sentiment", "log_return"), "sentiment", "log_return", digits=8)


@query("alignment_diagnostics", "SELECT symbol, count(*) AS n_bars, count(log_return) AS n_valid, count(*) FILTER (close IS NULL) AS n_empty, round(avg((n_articles > 0)::INT), 6) AS coverage FROM series GROUP BY 1", "series")
def alignment_diagnostics(spark, sf):
    d = lagstats.diagnostics(_series(spark, sf), 0)
    return _r(d.select("symbol", "n_bars", "n_valid", "n_empty", "coverage"), "coverage")


def _ccf(spark, sf):
    return lagstats.cross_correlation(_series(spark, sf), ["symbol"], "bucket", "sentiment", "log_return", 12)


@query("ccf", "SELECT symbol, lag, n, round(corr, 6) AS corr, round(1.959963984540054 / sqrt(n), 6) AS band, abs(corr) > 1.959963984540054 / sqrt(n) AS significant FROM lags", "lags")
def ccf(spark, sf):
    return _r(_ccf(spark, sf).select("symbol", "lag", "n", "corr", "band", "significant"), "corr", "band")


@query("ccf_peak", "SELECT symbol, lag, round(corr, 6) AS corr, n FROM lags WHERE lag > 0 AND corr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY abs(corr) DESC, lag) = 1", "lags")
def ccf_peak(spark, sf):
    return _r(lagstats.peak_lag(_ccf(spark, sf), ["symbol"]), "corr")


@query("bh_fdr", "WITH p AS (SELECT symbol, lag, least(1.0, abs(corr) * 9) AS p FROM lags), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p NULLS LAST, lag) AS r, count(p) OVER (PARTITION BY symbol) AS m FROM p) SELECT symbol, lag, round(p, 6) AS p, round(least(min(p * m / r) OVER (PARTITION BY symbol ORDER BY r DESC ROWS UNBOUNDED PRECEDING), 1.0), 6) AS p_fdr FROM r", "lags")
def bh_fdr(spark, sf):
    p = _ccf(spark, sf).select("symbol", "lag", F.least(F.lit(1.0), F.abs("corr") * 9).alias("p"))
    return _r(lagstats.benjamini_hochberg(p, ["symbol"], "p", "lag"), "p", "p_fdr")


@query(
    "rolling_ccf",
    """WITH n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS c FROM idx),
wins AS (SELECT n.*, w.w AS window_id FROM n CROSS JOIN generate_series(0, 100) AS w(w) WHERE n.i >= w.w * 96 AND n.i < w.w * 96 + 168 AND w.w * 96 + 168 <= n.c),
st AS (SELECT symbol, window_id, min(bucket) AS window_start, avg((n_articles > 0)::INT) AS coverage, count(*) FILTER (sentiment IS NULL OR log_return IS NULL) AS gaps FROM wins GROUP BY 1, 2)
SELECT symbol, window_id, window_start, round(coverage, 6) AS coverage, CASE WHEN gaps > 0 THEN 'skipped_gap' WHEN coverage < 0.05 THEN 'skipped_low_coverage' ELSE 'ok' END AS status FROM st""",
    "idx",
)
def rolling_ccf(spark, sf):
    out = lagstats.rolling_scan(_series(spark, sf), ["symbol"], "bucket", "sentiment", "log_return", 168, 96, 12, 0.05)
    return _r(out.select("symbol", F.col("window_id").cast("long").alias("window_id"), "window_start", "coverage", "status"), "coverage")


@query(
    "rolling_summary",
    """WITH s AS (SELECT symbol, bucket, close, n_articles, coalesce(sentiment, 0) AS sentiment, coalesce(log_return, 0) AS log_return, row_number() OVER (PARTITION BY symbol ORDER BY bucket) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS c FROM series),
wins AS (SELECT s.symbol, s.i, s.sentiment, s.log_return, w.w AS window_id FROM s CROSS JOIN generate_series(0, 100) AS w(w) WHERE s.i >= w.w * 96 AND s.i < w.w * 96 + 168 AND w.w * 96 + 168 <= s.c),
cc AS (SELECT a.symbol, a.window_id, k.k AS lag, covar_samp(a.sentiment, b.log_return) / nullif(stddev_samp(a.sentiment) * stddev_samp(b.log_return), 0) AS corr FROM wins a CROSS JOIN generate_series(1, 12) AS k(k) JOIN wins b ON a.symbol = b.symbol AND a.window_id = b.window_id AND b.i = a.i + k.k GROUP BY 1, 2, 3),
pk AS (SELECT * FROM cc WHERE corr IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, window_id ORDER BY abs(corr) DESC, lag) = 1),
cnt AS (SELECT symbol, count(DISTINCT window_id) AS n_windows, count(DISTINCT window_id) FILTER (sd_s > 0) AS n_ok FROM (SELECT symbol, window_id, stddev_samp(sentiment) AS sd_s FROM wins GROUP BY 1, 2) GROUP BY 1),
modes AS (SELECT symbol, lag FROM (SELECT symbol, lag, count(*) AS c FROM pk GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY c DESC, lag) = 1)
SELECT c.symbol, c.n_windows, c.n_ok, m.lag::INT AS mode_lag, round((SELECT stddev_samp(lag) FROM pk p WHERE p.symbol = c.symbol), 6) AS std_lag FROM cnt c LEFT JOIN modes m USING (symbol)""",
    "series",
)
def rolling_summary(spark, sf):
    s = _series(spark, sf).fillna(0.0, ["sentiment", "log_return"])
    scan = lagstats.rolling_scan(s, ["symbol"], "bucket", "sentiment", "log_return", 168, 96, 12, 0.0)
    return _r(lagstats.summarize_scan(scan, ["symbol"]), "std_lag")


@query("first_difference", "SELECT symbol, bucket, round(close - lag(close) OVER (PARTITION BY symbol ORDER BY bucket), 6) AS close FROM series", "series")
def first_difference(spark, sf):
    return _r(lagstats.difference(_series(spark, sf).select("symbol", "bucket", "close"), ["symbol"], "bucket", "close"), "close")


@query("granger")
def granger(spark, sf):
    s = _series(spark, sf).fillna(0.0, ["sentiment", "log_return"])
    return kernels.granger(s, ["symbol"], "bucket", "sentiment", "log_return", 8)


@query("stationarity")
def stationarity(spark, sf):
    return kernels.stationarity(_series(spark, sf).where("log_return is not null"), ["symbol"], "bucket", "log_return")


@query("make_stationary")
def make_stationary(spark, sf):
    return kernels.make_stationary(_series(spark, sf).select("symbol", "bucket", "close", "log_return"), ["symbol"], "bucket", ["close", "log_return"])


@query("strong_articles", "SELECT coin, time, url, round(score, 4) AS score FROM strong", "strong")
def strong_articles(spark, sf):
    return _r(events.strong_articles(scores(spark, sf), "finbert_compound", 0.9), "score", digits=4)


def _events(spark, sf):
    return events.cluster_events(events.strong_articles(scores(spark, sf), "finbert_compound", 0.9), 2)


@query("event_clusters", "SELECT coin, event_time, direction, round(magnitude, 8) AS magnitude, n_articles FROM evts", "evts")
def event_clusters(spark, sf):
    return _r(_events(spark, sf), "magnitude", digits=8)


def _cars(spark, sf):
    e = _events(spark, sf).withColumn("symbol", F.col("coin"))
    return events.event_car(e, bars.last_close(candles(spark, sf), 3600), 6, 7 * 86400)


@query("event_asof_base", "SELECT coin, event_time, base_price FROM based", "based")
def event_asof_base(spark, sf):
    return _cars(spark, sf).where("h = 1 and base_price is not null").select("coin", "event_time", "base_price")


@query("event_car", "SELECT coin, event_time, direction, h, round(car, 6) AS car FROM cars", "cars")
def event_car(spark, sf):
    return _r(_cars(spark, sf).where("base_price is not null").select("coin", "event_time", "direction", "h", "car"), "car")


@query("mean_car", "SELECT direction, h, round(avg(car), 6) AS mean_car, count(car) AS n FROM cars GROUP BY 1, 2", "cars")
def mean_car(spark, sf):
    return _r(events.mean_car(_cars(spark, sf).where("base_price is not null"), ["direction"]), "mean_car")


@query("optimal_exit", "SELECT coin, event_time, direction, h AS exit_h, round(car, 6) AS exit_car FROM cars WHERE car IS NOT NULL QUALIFY row_number() OVER (PARTITION BY coin, event_time, direction ORDER BY CASE WHEN direction = 'positive' THEN -car ELSE car END, h) = 1", "cars")
def optimal_exit(spark, sf):
    return _r(events.optimal_exit(_cars(spark, sf), ["coin", "event_time"]), "exit_car")


@query("exit_quantiles", "SELECT direction, count(*) AS n, quantile_cont(exit_h, 0.25) AS p25, quantile_cont(exit_h, 0.5) AS median, quantile_cont(exit_h, 0.75) AS p75, round_even(quantile_cont(exit_h, 0.5), 0)::INT AS median_h FROM (SELECT coin, event_time, direction, h AS exit_h FROM cars WHERE car IS NOT NULL QUALIFY row_number() OVER (PARTITION BY coin, event_time, direction ORDER BY CASE WHEN direction = 'positive' THEN -car ELSE car END, h) = 1) GROUP BY 1", "cars")
def exit_quantiles(spark, sf):
    return events.exit_distribution(events.optimal_exit(_cars(spark, sf), ["coin", "event_time"]), ["direction"])


@query("onset_hour", "WITH m AS (SELECT coin, direction, h, avg(car) AS mc FROM cars GROUP BY 1, 2, 3), f AS (SELECT *, coalesce(abs(mc) >= 0.2, false) AS s FROM m), r AS (SELECT *, h - row_number() OVER (PARTITION BY coin, direction, s ORDER BY h) AS g FROM f) SELECT coin, direction, min(st)::INT AS onset FROM (SELECT coin, direction, min(h) AS st, count(*) AS n FROM r WHERE s GROUP BY coin, direction, g) WHERE n >= 2 GROUP BY 1, 2", "cars")
def onset_hour(spark, sf):
    m = events.mean_car(_cars(spark, sf).where("base_price is not null"), ["coin", "direction"])
    return events.onset(m.withColumn("significant", F.coalesce(F.abs("mean_car") >= 0.2, F.lit(False))), ["coin", "direction"], 2)


@query("bootstrap_significance")
def bootstrap_significance(spark, sf):
    closes = bars.last_close(candles(spark, sf), 3600)
    tested = events.bootstrap_p(_cars(spark, sf), events.baseline_car(closes, 6, 500), ["symbol"], 500)
    return events.significance(tested, ["symbol", "direction"], 0.05, 0.01)


@query("baseline_starts", "SELECT symbol, n - 7 AS n_starts, 200 AS draws FROM (SELECT symbol, count(*) AS n FROM closes GROUP BY 1)", "closes")
def baseline_starts(spark, sf):
    closes = bars.last_close(candles(spark, sf), 3600)
    drawn = events.baseline_starts(closes, 6, 200, 1)
    n = closes.groupBy("symbol").agg((F.count("*") - 7).alias("n_starts"))
    ok = drawn.join(n, "symbol").where("i >= 0 and i < n_starts")
    return ok.groupBy("symbol", "n_starts").agg(F.count("*").cast("int").alias("draws"))


