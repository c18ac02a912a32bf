"""The driver's tables as this domain's inputs, and the same as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import label
from ..operators import bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_: str = ""):
    """Registers a query; with_ names the parts of the common table expressions below that its SQL needs."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            parts = [p for p in _CTES if p.split(" AS ", 1)[0] in _needed(with_.split())]
            own = sql.lstrip()
            if parts and own.startswith("WITH "):
                SQL[name] = "WITH " + ",\n".join([*parts, own[5:]])
            else:
                SQL[name] = ("WITH " + ",\n".join(parts) + "\n" if parts else "") + own
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("symbol"), F.col("ts").alias("time"), F.col("value").alias("price"), F.col("event_id").alias("seq"), "user_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def candles(spark: SparkSession, sf: str) -> DataFrame:
    return bars.candles_from_ticks(ticks(spark, sf))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    x = (F.col("k") - 50) / 50.0
    return ticks(spark, sf).select("time", F.concat(F.lit("u"), "user_id").alias("url"), F.col("symbol").alias("coin"), x.alias("finbert_compound"), (F.pmod(F.col("k") * 7, F.lit(100)) / 50.0 - 1).alias("vader_compound"), label(x).alias("finbert_label"), "seq")


SENTENCE = r"^[^.!?\n]*[.!?]?"


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as news: an hour apart by id, tagged by source. The first sentence is the title, all that follows the summary."""
    title = F.regexp_extract("text", SENTENCE, 0)
    rest = F.nullif(F.expr("substring(text, length(title) + 1)"), F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 720 as int), cast(doc_id % 60 as int), 0)").alias("time"), F.concat(F.lit("u"), F.col("doc_id") % 500).alias("url"), F.col("source").alias("source_name"), title.alias("title"), "text", F.when(F.col("doc_id") % 5 == 0, F.array()).otherwise(F.array(F.col("lang"), F.upper("lang"))).cast("array<string>").alias("coin_tags")).withColumn("summary", rest)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of four hours as predictions: probability by the mean of k (in whole 1/10,000), close by the highest price, returns a hundredth of it, two variants."""
    from pyspark.sql import Window as W

    from ..functions.columns import action, bucket

    g = ticks(spark, sf).groupBy(F.col("symbol").alias("coin"), bucket("time", 14400).alias("bucket")).agg(F.expr("sum(k) * 100 div count(k)").alias("m"), F.max("price").alias("close"))
    w = W.partitionBy("coin").orderBy("bucket")
    g = g.withColumn("next_return", F.round((F.lead("close").over(w) / F.col("close") - 1) / 100, 6)).where("next_return is not null")
    g = g.withColumn("variant", F.explode(F.array(F.lit("price+news"), F.lit("price_only"))))
    p = F.when(F.col("variant") == "price+news", F.col("m")).otherwise(10_000 - F.col("m")) / 10_000
    return g.select("variant", "coin", "bucket", p.alias("prob_up"), action(p, 0.52, 0.48).alias("action"), (F.col("next_return") > 0).cast("double").alias("label"), "next_return")


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    """features_bar of the events: hourly, with the five event types as coins and two of them as news streams."""
    from ..operators.features import build_features

    names = ("click", "error", "purchase", "signup", "view")
    renamed = candles(spark, sf).withColumn("symbol", F.upper("symbol"))
    return build_features(renamed, scores(spark, sf), ("1h",), 6, 24, {n.upper(): n for n in names}, {"clk": "click", "prc": "purchase"}, {"1h": 2})


_CTES = [
    "ticks AS (SELECT event_type AS symbol, ts AS time, value AS price, event_id AS seq, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
    "candles AS (SELECT symbol, date_trunc('minute', time) AS time, arg_min(price, (time, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (time, seq)) AS close, sum(price) AS volume, count(*) AS n_ticks FROM ticks GROUP BY 1, 2)",
    "minutes AS (SELECT *, CASE WHEN lag(time) OVER w = time - INTERVAL 1 MINUTE AND lag(close) OVER w > 0 AND close > 0 THEN ln(close / lag(close) OVER w) END AS r1m FROM candles WINDOW w AS (PARTITION BY symbol ORDER BY time))",
    "hourly AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, time) AS bucket, arg_min(open, time) AS open, max(high) AS high, min(low) AS low, arg_max(close, time) AS close, sum(volume) AS volume, count(*) AS n_candles, sqrt(sum(r1m * r1m)) AS realized_vol FROM minutes GROUP BY 1, 2)",
    "grid AS (SELECT symbol, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM hourly GROUP BY 1)",
    "scores AS (SELECT time, 'u' || user_id AS url, symbol AS coin, (k - 50) / 50.0::DOUBLE AS finbert_compound, ((k * 7) % 100) / 50.0::DOUBLE - 1 AS vader_compound, CASE WHEN (k - 50) / 50.0::DOUBLE >= 0.3 THEN 'positive' WHEN (k - 50) / 50.0::DOUBLE <= -0.3 THEN 'negative' ELSE 'neutral' END AS finbert_label, seq FROM ticks)",
    "arts AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY coin, url ORDER BY time, finbert_compound, vader_compound) = 1)",
    "sbars AS (SELECT upper(replace(coin, '/', '')) AS symbol, time_bucket(INTERVAL 1 HOUR, time) AS bucket, count(*) AS n_articles, sum((finbert_label = 'positive')::INT) AS n_positive, sum((finbert_label = 'negative')::INT) AS n_negative, avg(finbert_compound) AS finbert_mean, avg(vader_compound) AS vader_mean FROM arts GROUP BY 1, 2)",
    rf"news AS (SELECT *, nullif(substr(text, length(title) + 1), '') AS summary FROM (SELECT doc_id, text, TIMESTAMP '2024-01-01' + to_hours((doc_id % 720)::INT) + to_minutes((doc_id % 60)::INT) AS time, 'u' || (doc_id % 500) AS url, source AS source_name, regexp_extract(text, '{SENTENCE}', 0) AS title, CASE WHEN doc_id % 5 = 0 THEN [] ELSE [lang, upper(lang)] END AS coin_tags FROM documents))",
    "four AS (SELECT symbol AS coin, time_bucket(INTERVAL 4 HOUR, time) AS bucket, (sum(k)::BIGINT * 100 // count(k))::BIGINT AS m, max(price) AS close FROM ticks GROUP BY 1, 2)",
    "moves AS (SELECT * FROM (SELECT *, round((lead(close) OVER (PARTITION BY coin ORDER BY bucket) / close - 1) / 100, 6) AS next_return FROM four) WHERE next_return IS NOT NULL)",
    "both_variants AS (SELECT v.variant, coin, bucket, (CASE WHEN v.variant = 'price+news' THEN m ELSE 10000 - m END / 10000)::DOUBLE AS prob_up, next_return FROM moves, (VALUES ('price+news'), ('price_only')) v(variant))",
    "preds AS (SELECT *, CASE WHEN prob_up >= 0.52 THEN 'BUY' WHEN prob_up <= 0.48 THEN 'SELL' ELSE 'HOLD' END AS action, (next_return > 0)::INT::DOUBLE AS label FROM both_variants)",
    "pos AS (SELECT *, coalesce(last_value(CASE action WHEN 'BUY' THEN 1.0 WHEN 'SELL' THEN 0.0 END IGNORE NULLS) OVER (PARTITION BY variant, coin ORDER BY bucket ROWS UNBOUNDED PRECEDING), 0.0)::DOUBLE AS position FROM preds)",
    "moved AS (SELECT *, abs(position - coalesce(lag(position) OVER (PARTITION BY variant, coin ORDER BY bucket), 0)) AS t FROM pos)",
    "traded AS (SELECT * EXCLUDE t, t * 10 / 10000 AS fee, t > 0 AS trade, position * next_return - t * 10 / 10000 AS strategy_return FROM moved)",
    "closes AS (SELECT symbol, time_bucket(INTERVAL 1 HOUR, time) AS bucket, arg_max(close, time) AS close, count(*) AS n_candles FROM candles GROUP BY 1, 2)",
    "strong AS (SELECT coin, time, url, finbert_compound AS score FROM scores WHERE abs(finbert_compound) >= 0.9 QUALIFY row_number() OVER (PARTITION BY coin, url ORDER BY time, finbert_compound) = 1)",
    "cluster_ids AS (SELECT *, sum(n) OVER (PARTITION BY coin ORDER BY time ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY coin ORDER BY time) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS n FROM strong))",
    "evts AS (SELECT coin, min(time) AS event_time, CASE WHEN avg(score) > 0 THEN 'positive' ELSE 'negative' END AS direction, avg(abs(score)) AS magnitude, count(*) AS n_articles FROM cluster_ids GROUP BY coin, cluster)",
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) AS i FROM closes)",
    "based AS (SELECT e.*, n.symbol, n.close AS base_price, n.i FROM evts e ASOF JOIN numbered n ON e.coin = n.symbol AND e.event_time >= n.bucket)",
    "cars AS (SELECT b.coin, b.event_time, b.direction, h.h::INT AS h, b.base_price, ln(n.close / b.base_price) AS car FROM based b CROSS JOIN generate_series(1, 6) AS h(h) LEFT JOIN numbered n ON n.symbol = b.symbol AND n.i = b.i + h.h)",
    "closed AS (SELECT g.symbol, g.bucket, h.close, coalesce(h.n_candles, 0) AS n_candles FROM grid g LEFT JOIN hourly h USING (symbol, bucket))",
    "series AS (SELECT c.symbol, c.bucket, c.close, c.n_candles, coalesce(s.n_articles, 0) AS n_articles, coalesce(s.sent_mean, 0.0) AS sentiment, ln(c.close) - lag(ln(c.close)) OVER (PARTITION BY c.symbol ORDER BY c.bucket) AS log_return FROM closed c LEFT JOIN (SELECT coin AS symbol, time_bucket(INTERVAL 1 HOUR, time) AS bucket, avg(finbert_compound) AS sent_mean, sum(finbert_compound) AS sent_sum, count(*) AS n_articles FROM arts GROUP BY 1, 2) s USING (symbol, bucket))",
    "idx AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bucket) - 1 AS i FROM series)",
    "lags AS (SELECT a.symbol, k.k::INT AS lag, count(*) AS n, covar_samp(a.sentiment, b.log_return) / nullif(stddev_samp(a.sentiment) * stddev_samp(b.log_return), 0) AS corr FROM idx a CROSS JOIN generate_series(-12, 12) AS k(k) JOIN idx b ON b.symbol = a.symbol AND b.i = a.i + k.k WHERE a.sentiment IS NOT NULL AND b.log_return IS NOT NULL GROUP BY 1, 2)",
]
_USES = {
    "candles": ["ticks"], "minutes": ["candles"], "hourly": ["minutes"], "grid": ["hourly"], "scores": ["ticks"], "arts": ["scores"], "sbars": ["arts"], "four": ["ticks"], "moves": ["four"], "both_variants": ["moves"], "preds": ["both_variants"],
    "pos": ["preds"], "moved": ["pos"], "traded": ["moved"], "closes": ["candles"], "strong": ["scores"], "cluster_ids": ["strong"], "evts": ["cluster_ids"], "numbered": ["closes"], "based": ["evts", "numbered"], "cars": ["based"],
    "closed": ["grid"], "series": ["closed", "arts"], "idx": ["series"], "lags": ["idx"],
}


def _needed(names: list[str]) -> set[str]:
    out: set[str] = set()
    todo = list(names)
    while todo:
        n = todo.pop()
        if n not in out:
            out.add(n)
            todo += _USES.get(n, [])
    return out
