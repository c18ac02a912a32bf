"""Queries on bars, sentiment and features."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import bucket
from ..operators import bars, features, islands, joins
from .domain import articles, candles, feature_rows, query, scores, table, ticks


def _r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


for _name, _s, _i in (("ohlcv_15min", 900, "15 MINUTE"), ("ohlcv_1h", 3600, "1 HOUR"), ("ohlcv_4h", 14400, "4 HOUR"), ("ohlcv_1d", 86400, "1 DAY")):

    @query(
        _name,
        f"SELECT symbol, time_bucket(INTERVAL {_i}, time) AS bucket, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, round(sum(volume), 4) AS volume, count(*) AS n_candles, round(sqrt(sum(r1m * r1m)), 6) AS realized_vol FROM minutes GROUP BY 1, 2",
        "minutes",
    )
    def _ohlcv(spark, sf, seconds=_s):
        return _r(_r(bars.market_bars(bars.with_minute_returns(candles(spark, sf)), seconds), "realized_vol"), "volume", digits=4)


@query("minute_returns", "SELECT symbol, time, close, round(r1m, 8) AS r1m FROM minutes", "minutes")
def minute_returns(spark, sf):
    return _r(bars.with_minute_returns(candles(spark, sf)).select("symbol", "time", "close", "r1m"), "r1m", digits=8)


@query(
    "bars_regular_grid",
    """WITH hb AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, time) AS bucket, arg_min(price, (time, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (time, seq)) AS close, count(*) AS n FROM ticks GROUP BY 1, 2)
SELECT symbol, bucket, open, high, low, close, n, round(log_return, 6) AS log_return, round(stddev_samp(log_return) OVER f, 6) AS vol_6, (sum(n) OVER f)::BIGINT AS n_6
FROM (SELECT g.symbol, g.bucket, h.open, h.high, h.low, h.close, coalesce(h.n, 0) AS n, ln(h.close) - lag(ln(h.close)) OVER (PARTITION BY g.symbol ORDER BY g.bucket) AS log_return
  FROM (SELECT symbol, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM hb GROUP BY 1) g LEFT JOIN hb h USING (symbol, bucket))
WINDOW f AS (PARTITION BY symbol ORDER BY bucket ROWS 5 PRECEDING)""",
    "ticks",
)
def bars_regular_grid(spark, sf):
    raw = bars.candles_from_ticks(ticks(spark, sf), 3600).select("symbol", F.col("time").alias("bucket"), "open", "high", "low", "close", F.col("n_ticks").alias("n"))
    g = bars.on_grid(raw, ["symbol"], 3600).withColumn("n", F.coalesce("n", F.lit(0)))
    g = g.withColumn("log_return", bars.log_return(F.col("close"), W.partitionBy("symbol").orderBy("bucket")))
    f = bars.frame(["symbol"], "bucket", 6)
    return _r(g.withColumns({"vol_6": F.stddev_samp("log_return").over(f), "n_6": F.sum("n").over(f)}), "log_return", "vol_6")


@query("last_close_bars", "SELECT * FROM closes", "closes")
def last_close_bars(spark, sf):
    return bars.last_close(candles(spark, sf), 3600)


@query("bar_completeness", "SELECT symbol, count(*) AS n_bars, count(*) FILTER (n_candles >= 2) AS n_complete, min(bucket) AS first, max(bucket) AS last FROM hourly GROUP BY 1", "hourly")
def bar_completeness(spark, sf):
    b = bars.last_close(candles(spark, sf), 3600)
    return b.groupBy("symbol").agg(F.count("*").alias("n_bars"), F.count_if(F.col("n_candles") >= 2).alias("n_complete"), F.min("bucket").alias("first"), F.max("bucket").alias("last"))


@query("dedup_articles", "SELECT coin, url, time, round(finbert_compound, 4) AS finbert_compound, finbert_label FROM arts", "arts")
def dedup_articles(spark, sf):
    return _r(bars.dedup_articles(scores(spark, sf)).select("coin", "url", "time", "finbert_compound", "finbert_label"), "finbert_compound", digits=4)


@query("sentiment_bars", "SELECT symbol, bucket, n_articles, n_positive::BIGINT AS n_positive, n_negative::BIGINT AS n_negative, round(finbert_mean, 8) AS finbert_mean, round(vader_mean, 8) AS vader_mean FROM sbars", "sbars")
def sentiment_bars(spark, sf):
    return _r(bars.sentiment_bars(bars.dedup_articles(scores(spark, sf)), 3600), "finbert_mean", "vader_mean", digits=8)


@query("latest_per_symbol", "SELECT symbol, time, close FROM candles QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) = 1", "candles")
def latest_per_symbol(spark, sf):
    return bars.latest(candles(spark, sf).select("symbol", "time", "close"), ["symbol"], ["time"])


@query("last_n_per_symbol", "SELECT symbol, time, close FROM candles QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY time DESC) <= 5", "candles")
def last_n_per_symbol(spark, sf):
    return bars.latest(candles(spark, sf).select("symbol", "time", "close"), ["symbol"], ["time"], 5)


_STREAMS = {"clk": "CLICK", "prc": "PURCHASE"}
_FEATURES_SQL = f"""
WITH g AS (SELECT upper(gr.symbol) AS symbol, gr.symbol AS coin, gr.bucket, h.open, h.high, h.low, h.close, h.volume, coalesce(h.n_candles, 0) AS n_candles, h.realized_vol FROM grid gr LEFT JOIN hourly h USING (symbol, bucket)),
kept AS (SELECT * FROM g QUALIFY bucket < max(bucket) OVER (PARTITION BY symbol) OR n_candles >= 2),
j AS (SELECT k.*, coalesce(s.n_articles, 0)::INT AS n_articles, coalesce(s.n_positive, 0)::INT AS n_positive, coalesce(s.n_negative, 0)::INT AS n_negative, s.finbert_mean, s.vader_mean, coalesce(s.finbert_mean, 0.0) AS finbert_score, coalesce(s.vader_mean, 0.0) AS vader_score,
  ln(k.close) - lag(ln(k.close)) OVER (PARTITION BY k.symbol ORDER BY k.bucket) AS log_return,
  {", ".join(f"coalesce({k}.finbert_mean, 0.0) AS {k}_news_score, coalesce({k}.n_articles, 0)::INT AS {k}_news_count" for k in _STREAMS)}
  FROM kept k LEFT JOIN sbars s USING (symbol, bucket) {" ".join(f"LEFT JOIN (SELECT bucket, finbert_mean, n_articles FROM sbars WHERE symbol = '{v}') {k} ON {k}.bucket = k.bucket" for k, v in _STREAMS.items())})
SELECT bucket, symbol, coin, '1h' AS freq, open, high, low, close, round(volume, 4) AS volume, n_candles::INT AS n_candles, n_candles = 2 AS is_complete, round(log_return, 8) AS log_return, round(abs(log_return), 8) AS abs_return, round(realized_vol, 8) AS realized_vol,
  n_articles, n_positive, n_negative, round(finbert_mean, 8) AS finbert_mean, round(vader_mean, 8) AS vader_mean, round(finbert_score, 8) AS finbert_score, round(vader_score, 8) AS vader_score,
  round(avg(finbert_score) OVER s, 8) AS finbert_roll_short, round(avg(finbert_score) OVER l, 8) AS finbert_roll_long,
  CASE WHEN stddev_samp(finbert_score) OVER l > 0 THEN round((finbert_score - avg(finbert_score) OVER l) / stddev_samp(finbert_score) OVER l, 8) END AS finbert_zscore,
  (sum(n_articles) OVER s)::INT AS articles_roll_short, (sum(n_articles) OVER l)::INT AS articles_roll_long, round(stddev_samp(log_return) OVER s, 8) AS ret_vol_short, round(stddev_samp(log_return) OVER l, 8) AS ret_vol_long,
  {", ".join(f"round({k}_news_score, 8) AS {k}_news_score, {k}_news_count, round(avg({k}_news_score) OVER s, 8) AS {k}_news_roll" for k in _STREAMS)}
FROM j WINDOW s AS (PARTITION BY symbol ORDER BY bucket ROWS 5 PRECEDING), l AS (PARTITION BY symbol ORDER BY bucket ROWS 23 PRECEDING)"""


@query("features_bar", _FEATURES_SQL, "grid sbars hourly")
def features_bar(spark, sf):
    df = feature_rows(spark, sf)
    exact = {"open", "high", "low", "close"}
    # Means of few scores of two decimals lie halfway between values of six digits, but never of eight.
    return _r(_r(df, *[f.name for f in df.schema if f.dataType.typeName() == "double" and f.name not in exact | {"volume"}], digits=8), "volume", digits=4)


@query("feature_run_summary", "SELECT '1h' AS freq, count(*) AS n, min(bucket) AS first, max(bucket) AS last, count(*) FILTER (n_candles <> 2) AS n_incomplete, count(*) FILTER (a > 0) AS n_with_news FROM (SELECT c.*, coalesce(s.n_articles, 0) AS a FROM (SELECT * FROM closed QUALIFY bucket < max(bucket) OVER (PARTITION BY symbol) OR n_candles >= 2) c LEFT JOIN sbars s ON s.symbol = upper(c.symbol) AND s.bucket = c.bucket)", "closed sbars")
def feature_run_summary(spark, sf):
    return features.run_summary(feature_rows(spark, sf))


@query("sliding_bars", "SELECT symbol, b + to_hours(o.o::INT) AS bucket, arg_min(price, (time, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (time, seq)) AS close, count(*) AS n FROM (SELECT *, time_bucket(INTERVAL 1 HOUR, time) AS b FROM ticks) t CROSS JOIN (VALUES (0), (-1)) o(o) GROUP BY 1, 2", "ticks")
def sliding_bars(spark, sf):
    return bars.time_window_bars(ticks(spark, sf), "2 hours", "1 hour").drop("bucket_end")


@query("session_windows", "SELECT symbol, min(time) AS start, max(time) + INTERVAL 2 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY symbol ORDER BY time ROWS UNBOUNDED PRECEDING) AS c FROM (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY symbol ORDER BY time) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS f FROM (SELECT DISTINCT * FROM ticks))) GROUP BY symbol, c", "ticks")
def session_windows(spark, sf):
    return bars.session_bars(ticks(spark, sf), "symbol", "2 hours")


@query("market_gaps", "SELECT symbol, bucket + INTERVAL 1 HOUR AS start, nxt AS \"end\", (epoch(nxt - bucket) / 3600 - 1)::BIGINT AS n FROM (SELECT *, lead(bucket) OVER (PARTITION BY symbol ORDER BY bucket) AS nxt FROM closes) WHERE nxt > bucket + INTERVAL 1 HOUR UNION ALL SELECT symbol, TIMESTAMP '2023-12-31', min(bucket), (epoch(min(bucket) - TIMESTAMP '2023-12-31') / 3600)::BIGINT FROM closes GROUP BY 1 HAVING min(bucket) > TIMESTAMP '2023-12-31' UNION ALL SELECT symbol, max(bucket) + INTERVAL 1 HOUR, TIMESTAMP '2024-02-01', (epoch(TIMESTAMP '2024-02-01' - max(bucket)) / 3600 - 1)::BIGINT FROM closes GROUP BY 1 HAVING max(bucket) + INTERVAL 1 HOUR < TIMESTAMP '2024-02-01'", "closes")
def market_gaps(spark, sf):
    at = lambda s: F.expr(f"timestamp_ntz'{s} 00:00:00'")
    return islands.all_gaps(bars.last_close(candles(spark, sf), 3600), ["symbol"], "bucket", 3600, at("2023-12-31"), at("2024-02-01"))


@query("missing_minutes", "SELECT symbol, sum((epoch(nxt - time) / 60)::BIGINT - 1)::BIGINT AS missing FROM (SELECT *, lead(time) OVER (PARTITION BY symbol ORDER BY time) AS nxt FROM candles) WHERE nxt > time + INTERVAL 1 MINUTE GROUP BY 1", "candles")
def missing_minutes(spark, sf):
    return islands.gaps(candles(spark, sf), ["symbol"], "time", 60).groupBy("symbol").agg(F.sum("n").alias("missing"))


_ISLAND = "SELECT symbol, min(bucket) AS start, max(bucket) AS \"end\", count(*) AS n FROM (SELECT *, sum(ch) OVER (PARTITION BY symbol ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN c IS DISTINCT FROM lag(c) OVER (PARTITION BY symbol ORDER BY bucket) THEN 1 ELSE 0 END AS ch FROM (SELECT symbol, bucket, {c} AS c FROM closed))) WHERE c GROUP BY symbol, isl"


@query("gap_runs", _ISLAND.format(c="close IS NULL"), "closed")
def gap_runs(spark, sf):
    return islands.runs_where(bars.on_grid(bars.last_close(candles(spark, sf), 3600), ["symbol"], 3600), ["symbol"], "bucket", F.col("close").isNull())


@query("longest_complete_run", f"SELECT symbol, start, \"end\", n FROM ({_ISLAND.format(c='close IS NOT NULL')}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, start) = 1", "closed")
def longest_complete_run(spark, sf):
    from ..operators.lagstats import longest_complete_run as longest

    return longest(bars.on_grid(bars.last_close(candles(spark, sf), 3600), ["symbol"], 3600), ["symbol"], "bucket", ["close"])


@query("significant_windows", _ISLAND.format(c="n_candles >= 3"), "closed")
def significant_windows(spark, sf):
    g = bars.on_grid(bars.last_close(candles(spark, sf), 3600), ["symbol"], 3600)
    return islands.runs_where(g, ["symbol"], "bucket", F.col("n_candles") >= 3)


@query("day_runs", "SELECT symbol, min(d) AS start, max(d) AS \"end\", count(*) AS n FROM (SELECT symbol, d, d - (row_number() OVER (PARTITION BY symbol ORDER BY d))::INT AS g FROM (SELECT DISTINCT o_orderpriority AS symbol, o_orderdate::DATE AS d FROM orders)) GROUP BY symbol, g")
def day_runs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("d"))
    return islands.day_runs(o, ["symbol"], "d")


@query("coalesce_ranges", "SELECT symbol, min(a) AS start, max(b) AS \"end\", count(*) AS n FROM (SELECT *, sum(CASE WHEN reach IS NULL OR a >= reach + INTERVAL 3 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(b) OVER (PARTITION BY symbol ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT symbol, time AS a, time + to_minutes(k) AS b FROM ticks))) GROUP BY symbol, g", "ticks")
def coalesce_ranges(spark, sf):
    r = ticks(spark, sf).select("symbol", F.col("time").alias("start"), (F.col("time") + F.expr("make_dt_interval(0, 0, k, 0)")).alias("end"))
    return islands.join_ranges(r, ["symbol"], 3 * 3600)


@query("unscored_anti_join", "SELECT doc_id, time, url FROM news n WHERE len(coin_tags) > 0 AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = n.doc_id) ORDER BY time DESC, doc_id LIMIT 100", "news")
def unscored_anti_join(spark, sf):
    from ..operators.joins import not_in

    todo = not_in(articles(spark, sf).where(F.size("coin_tags") > 0), table(spark, sf, "labels"), ["doc_id"])
    return todo.orderBy(F.desc("time"), "doc_id").limit(100).select("doc_id", "time", "url")


@query("scored_exists_flag", "SELECT doc_id, url, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = n.doc_id) AS scored FROM news n", "news")
def scored_exists_flag(spark, sf):
    return joins.with_flag(articles(spark, sf).select("doc_id", "url"), table(spark, sf, "labels"), ["doc_id"], "scored")


@query("news_gap_days", "SELECT t.tag, d.d::DATE AS day, count(n.doc_id) AS n FROM (VALUES ('en'), ('de'), ('ES')) t(tag) CROSS JOIN generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-04', INTERVAL 1 DAY) AS d(d) LEFT JOIN news n ON n.time >= d.d AND n.time < d.d + INTERVAL 1 DAY AND list_contains(n.coin_tags, t.tag) GROUP BY 1, 2 HAVING count(n.doc_id) < 4", "news")
def news_gap_days(spark, sf):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-04").cast("date"))).alias("day")).select(F.explode(F.array(*[F.lit(t) for t in ("en", "de", "ES")])).alias("tag"), "day")
    return joins.days_below(articles(spark, sf), days, "tag", "day", "time", "coin_tags", 4)


@query("stale_bars", "SELECT c.symbol, c.bucket, c.changed FROM (SELECT symbol, time_bucket(INTERVAL 1 HOUR, time) AS bucket, max(time) AS changed FROM ticks GROUP BY 1, 2) c LEFT JOIN (SELECT symbol, time_bucket(INTERVAL 1 HOUR, time) AS bucket, min(time) + INTERVAL 30 MINUTE AS computed_at FROM ticks WHERE seq % 3 > 0 GROUP BY 1, 2) f USING (symbol, bucket) WHERE f.computed_at IS NULL OR c.changed > f.computed_at", "ticks")
def stale_bars(spark, sf):
    t = ticks(spark, sf).withColumn("bucket", bucket("time", 3600))
    changed = t.groupBy("symbol", "bucket").agg(F.max("time").alias("changed"))
    computed = t.where("seq % 3 > 0").groupBy("symbol", "bucket").agg((F.min("time") + F.expr("interval 30 minutes")).alias("computed_at"))
    return joins.changed_since(changed, computed, ["symbol", "bucket"], "changed", "computed_at").drop("computed_at")


@query("recent_news_topk", "SELECT s.coin, s.time, s.url, a.title FROM (SELECT * FROM scores ORDER BY time DESC, seq DESC LIMIT 50) s LEFT JOIN (SELECT url, min(title) AS title FROM news GROUP BY 1) a USING (url)", "scores news")
def recent_news_topk(spark, sf):
    top = scores(spark, sf).orderBy(F.desc("time"), F.desc("seq")).limit(50)
    titles = articles(spark, sf).groupBy("url").agg(F.min("title").alias("title"))
    return top.join(titles, "url", "left").select("coin", "time", "url", "title")


@query("input_coins_full_outer", "SELECT coalesce(a.bucket, b.bucket) AS bucket, a.close AS clk_close, a.n_candles AS clk_n, b.close AS prc_close, b.n_candles AS prc_n FROM (SELECT * FROM closes WHERE symbol = 'click') a FULL JOIN (SELECT * FROM closes WHERE symbol = 'purchase') b ON a.bucket = b.bucket", "closes")
def input_coins_full_outer(spark, sf):
    return joins.wide_by(bars.last_close(candles(spark, sf), 3600), "symbol", {"click": "clk", "purchase": "prc"}, "bucket", {"close": "close", "n_candles": "n"})


@query("array_merge_upsert", "SELECT url, list_sort(list_distinct(list_concat(coalesce(o, []), coalesce(n, [])))) AS coin_tags FROM (SELECT url, flatten(list(coin_tags)) AS o FROM news GROUP BY 1) FULL JOIN (SELECT url, list(source_name) AS n FROM news GROUP BY 1) USING (url)", "news")
def array_merge_upsert(spark, sf):
    a = articles(spark, sf)
    old = a.groupBy("url").agg(F.flatten(F.collect_list("coin_tags")).alias("coin_tags"))
    new = a.groupBy("url").agg(F.collect_list("source_name").alias("coin_tags"))
    return joins.merged_arrays(old, new, ["url"], "coin_tags")


@query("upsert_latest", "SELECT o.symbol, o.bucket, o.close FROM closes o WHERE NOT EXISTS (SELECT 1 FROM closes n WHERE n.symbol = o.symbol AND n.bucket = o.bucket AND hour(n.bucket) % 2 = 0) UNION ALL SELECT symbol, bucket, round(close * 2, 4) FROM closes WHERE hour(bucket) % 2 = 0", "closes")
def upsert_latest(spark, sf):
    old = bars.last_close(candles(spark, sf), 3600).select("symbol", "bucket", "close")
    new = old.where(F.hour("bucket") % 2 == 0).withColumn("close", F.round(F.col("close") * 2, 4))
    return joins.upserted(old, new, ["symbol", "bucket"])


@query("insert_if_absent", "SELECT symbol, time, close FROM (SELECT symbol, time + INTERVAL 30 MINUTE AS time, close FROM candles) c WHERE NOT EXISTS (SELECT 1 FROM candles o WHERE o.symbol = c.symbol AND o.time = c.time)", "candles")
def insert_if_absent(spark, sf):
    old = candles(spark, sf).select("symbol", "time", "close")
    new = old.withColumn("time", F.col("time") + F.expr("interval 30 minutes"))
    return joins.inserted_if_absent(old, new.unionByName(new), ["symbol", "time"], ["close"])


@query("batch_dedup_last_wins", "SELECT coin, url, time, seq FROM scores QUALIFY row_number() OVER (PARTITION BY coin, url ORDER BY seq DESC) = 1", "scores")
def batch_dedup_last_wins(spark, sf):
    return joins.last_wins(scores(spark, sf).select("coin", "url", "time", "seq"), ["coin", "url"], "seq")


@query("explode_tags", "SELECT doc_id, unnest(coin_tags) AS coin FROM news", "news")
def explode_tags(spark, sf):
    return articles(spark, sf).select("doc_id", F.explode("coin_tags").alias("coin"))


@query("as_of_join", "SELECT a.doc_id, a.time, s.time AS tick_time, s.price FROM news a ASOF LEFT JOIN (SELECT time, arg_max(price, seq) AS price FROM ticks WHERE symbol = 'view' GROUP BY 1) s ON a.time >= s.time", "news ticks")
def as_of_join(spark, sf):
    left = articles(spark, sf).select("doc_id", "time", F.lit("view").alias("symbol"))
    right = ticks(spark, sf).where("symbol = 'view'").groupBy("symbol", F.col("time").alias("tick_time")).agg(F.max_by("price", "seq").alias("price")).withColumn("_k", F.col("tick_time"))
    return joins.as_of(left, right, ["symbol"], "time", "_k", ["tick_time", "price"], 86400).drop("symbol")
