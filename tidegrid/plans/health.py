"""Queries on the state of the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import bucket
from ..operators import bars, health
from ..sources import readers
from .domain import articles, candles, query, scores, table, ticks


@query("health_freshness", "SELECT stage, latest, round(epoch(TIMESTAMP '2024-02-01' - latest) / 60, 1) AS lag_minutes, CASE WHEN epoch(TIMESTAMP '2024-02-01' - latest) / 60 > b THEN 'stale' ELSE 'ok' END AS status FROM (SELECT 'market' AS stage, max(time) AS latest, 5 AS b FROM candles UNION ALL SELECT 'news', max(time), 240 FROM news UNION ALL SELECT 'scores', max(time), 100000 FROM scores)", "candles news scores")
def health_freshness(spark, sf):
    tables = {"market": (candles(spark, sf), "time"), "news": (articles(spark, sf), "time"), "scores": (scores(spark, sf), "time")}
    return readers.health(tables, "2024-02-01 00:00:00", {"market": 5, "news": 240, "scores": 100000})


@query("coverage_report", "SELECT coin, min(day) AS start, max(day) AS \"end\", count(*) AS n FROM (SELECT *, day - (row_number() OVER (PARTITION BY coin ORDER BY day))::INT AS g FROM (SELECT t.coin, d.d::DATE AS day FROM (VALUES ('en'), ('de'), ('ES')) t(coin) CROSS JOIN generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-04', INTERVAL 1 DAY) AS d(d) LEFT JOIN news n ON n.time >= d.d AND n.time < d.d + INTERVAL 1 DAY AND list_contains(n.coin_tags, t.coin) GROUP BY 1, 2 HAVING count(n.doc_id) < 5)) GROUP BY coin, g", "news")
def coverage_report(spark, sf):
    days = spark.range(1).select(F.explode(F.sequence(F.lit("2024-01-01").cast("date"), F.lit("2024-02-04").cast("date"))).alias("day")).select(F.explode(F.array(*[F.lit(t) for t in ("en", "de", "ES")])).alias("coin"), "day")
    return health.news_gaps(articles(spark, sf), days, 5)


@query("gap_finding", "SELECT 'market' AS area, 'gaps' AS \"check\", CASE WHEN sum(n) = 0 THEN 'OK' WHEN sum(n) <= 100 THEN 'WARN' ELSE 'FAIL' END AS status, sum(n)::BIGINT AS pending, 'minutes' AS unit, 'market' AS action FROM (SELECT (epoch(nxt - time) / 60 - 1)::BIGINT AS n FROM (SELECT time, lead(time) OVER (PARTITION BY symbol ORDER BY time) AS nxt FROM candles) WHERE nxt > time + INTERVAL 1 MINUTE UNION ALL SELECT (epoch(min(time) - TIMESTAMP '2023-12-31') / 60)::BIGINT FROM candles GROUP BY symbol UNION ALL SELECT (epoch(TIMESTAMP '2024-02-01' - INTERVAL 2 MINUTE - max(time)) / 60 - 1)::BIGINT FROM candles GROUP BY symbol)", "candles")
def gap_finding(spark, sf):
    gaps = health.market_gaps(candles(spark, sf), "2023-12-31 00:00:00", "2024-02-01 00:00:00")
    return health.gap_finding(gaps, "market", "gaps", "minutes", "market", 100).drop("detail")


@query("fetch_ranges", "SELECT symbol, min(a) AS start, max(b) AS \"end\", count(*) AS n FROM (SELECT *, sum(CASE WHEN reach IS NULL OR a >= reach + INTERVAL 100 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY a ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, max(b) OVER (PARTITION BY symbol ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT symbol, time + INTERVAL 1 MINUTE AS a, nxt AS b FROM (SELECT symbol, time, lead(time) OVER (PARTITION BY symbol ORDER BY time) AS nxt FROM candles) WHERE nxt > time + INTERVAL 1 MINUTE AND epoch(nxt - time) > 18000))) GROUP BY symbol, g", "candles")
def fetch_ranges(spark, sf):
    from ..operators.islands import gaps

    return health.fetch_ranges(gaps(candles(spark, sf), ["symbol"], "time", 60).where(F.timestamp_diff("SECOND", F.col("start"), F.col("end")) > 17940), 100)


@query("rebuild_from", "SELECT freq, min(bucket) AS rebuild_from, count(*) AS pending FROM (SELECT '1h' AS freq, c.symbol, c.bucket FROM (SELECT symbol, time_bucket(INTERVAL 1 HOUR, time) AS bucket, max(time) AS changed FROM ticks GROUP BY 1, 2) c LEFT JOIN (SELECT symbol, time_bucket(INTERVAL 1 HOUR, time) AS bucket, min(time) + INTERVAL 30 MINUTE AS computed_at FROM ticks WHERE seq % 3 > 0 GROUP BY 1, 2) f USING (symbol, bucket) WHERE f.computed_at IS NULL OR c.changed > f.computed_at) GROUP BY 1", "ticks")
def rebuild_from(spark, sf):
    t = ticks(spark, sf).withColumns({"bucket": bucket("time", 3600), "freq": F.lit("1h")})
    changed = t.groupBy("freq", "symbol", "bucket").agg(F.max("time").alias("changed"))
    computed = t.where("seq % 3 > 0").groupBy("freq", "symbol", "bucket").agg((F.min("time") + F.expr("interval 30 minutes")).alias("computed_at"))
    return health.rebuild_from(changed, computed)


@query("scoring_backlog", "SELECT count(*) AS pending, min(time) AS oldest FROM news n WHERE len(coin_tags) > 0 AND NOT EXISTS (SELECT 1 FROM scores s WHERE s.url = n.url AND s.time = n.time)", "news scores")
def scoring_backlog(spark, sf):
    return health.backlog(articles(spark, sf), scores(spark, sf)).agg(F.count("*").alias("pending"), F.min("time").alias("oldest"))


@query("signal_recency", "SELECT symbol, max(bucket) AS latest, round(epoch(TIMESTAMP '2024-01-31' - max(bucket)) / 60, 1) AS minutes, CASE WHEN epoch(TIMESTAMP '2024-01-31' - max(bucket)) / 60 > 90 THEN 'WARN' ELSE 'OK' END AS status FROM closes GROUP BY 1", "closes")
def signal_recency(spark, sf):
    return health.recency(bars.last_close(candles(spark, sf), 3600), "bucket", ["symbol"], "2024-01-31 00:00:00", 90)


@query("consumer_lag", "SELECT sum(greatest(o_orderkey - o_custkey, 0))::BIGINT AS pending, CASE WHEN sum(greatest(o_orderkey - o_custkey, 0)) > 1000 THEN 'WARN' ELSE 'OK' END AS status FROM orders")
def consumer_lag(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("end_offset"), F.col("o_custkey").alias("committed"))
    return health.consumer_lag(o, 1000)


@query("finding_summary", "SELECT count(*) FILTER (s = 'OK') AS ok, count(*) FILTER (s = 'WARN') AS warn, count(*) FILTER (s = 'FAIL') AS fail, ['OK', 'WARN', 'FAIL'][max(CASE s WHEN 'OK' THEN 1 WHEN 'WARN' THEN 2 ELSE 3 END)] AS worst FROM (SELECT CASE WHEN p_size > 45 THEN 'FAIL' WHEN p_size > 25 THEN 'WARN' ELSE 'OK' END AS s FROM part)")
def finding_summary(spark, sf):
    p = table(spark, sf, "part").select(F.when(F.col("p_size") > 45, "FAIL").when(F.col("p_size") > 25, "WARN").otherwise("OK").alias("status"))
    return health.summary(p)


@query("training_history", "SELECT coin, count(label) AS n, CASE WHEN count(label) < 200 THEN 'FAIL' ELSE 'OK' END AS status FROM preds GROUP BY 1", "preds")
def training_history(spark, sf):
    from .domain import predictions

    return health.training_history(predictions(spark, sf), 200)


@query("news_recent", "SELECT s.url, s.time, s.coin, a.title, a.source_name FROM (SELECT * FROM scores WHERE coin = 'view' ORDER BY time DESC, url, coin LIMIT 20) s LEFT JOIN (SELECT url, time, title, source_name FROM news) a ON a.url = s.url AND a.time = s.time", "scores news")
def news_recent(spark, sf):
    return readers.news_recent(scores(spark, sf).select("coin", "time", "url"), articles(spark, sf), 20, "view")


@query("star_daily_revenue", "SELECT n_name, o_orderdate::DATE AS day, round(sum(l_extendedprice::DECIMAL(18,4) * (1 - l_discount::DECIMAL(18,4))), 2)::DOUBLE AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY 1, 2")
def star_daily_revenue(spark, sf):
    """Two-level reading of the star tables: filters and columns reach the scans, small tables are broadcast if Spark finds them small."""
    li, o, c, n = (table(spark, sf, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o.where("o_orderdate >= timestamp_ntz'1996-01-01 00:00:00'"), F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    amount = F.col("l_extendedprice").cast("decimal(18,4)") * (1 - F.col("l_discount").cast("decimal(18,4)"))
    return j.groupBy("n_name", F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum(amount), 2).cast("double").alias("revenue"), F.count("*").alias("n"))
