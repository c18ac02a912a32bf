"""Messages into rows, with a reason for every one that is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import finite, published
from ..sources.readers import KLINE

_OHLC = ("open", "high", "low", "close")
#: Milliseconds of the years 1970 to 9999.
_MOST_MS = 253402300799999


def _is_object(value: Column) -> Column:
    return F.coalesce(F.trim(value).startswith("{"), F.lit(False)) & F.try_parse_json(value).isNotNull()


def _quoted_or_number(column: str, name: str) -> Column:
    """A field's text, null for true and false: they are no numbers."""
    x = F.get_json_object(column, f"$.{name}")
    return F.when(~x.isin("true", "false"), x)


def candles(messages: DataFrame, value: str = "value") -> DataFrame:
    """messages plus a candle's columns and reason: null for a good one, 'open' for one not closed (to be passed over), else what is wrong.

    All fields are read as text first, so a wrong type is a reason and never an error.
    """
    t = lambda n: F.when(F.get_json_object(value, f"$.{n}").isin("true", "false"), None).otherwise(F.get_json_object(value, f"$.{n}"))
    out = messages.withColumns({"_ok": _is_object(F.col(value)), "symbol": F.get_json_object(value, "$.symbol"), "exchange": F.get_json_object(value, "$.exchange"), "_a": t("kline_start_time").try_cast("long"), "_b": t("kline_close_time").try_cast("long"), "_c": F.get_json_object(value, "$.is_closed")})
    out = out.withColumns({c: finite(_quoted_or_number(value, c)) for c in (*_OHLC, "volume")})
    missing = F.lit(False)
    for c in ("symbol", "exchange", "kline_start_time", "kline_close_time", *_OHLC, "volume"):
        missing = missing | F.get_json_object(value, f"$.{c}").isNull()
    bad_number = F.lit(False)
    for c in (*_OHLC, "volume"):
        bad_number = bad_number | F.col(c).isNull()
    low = F.col("_a").isNull() | F.col("_b").isNull() | (F.col("_a") <= 0) | (F.col("_a") > _MOST_MS) | (F.col("_b") > _MOST_MS)
    price = F.lit(False)
    for c in _OHLC:
        price = price | (F.col(c) <= 0)
    reason = (
        F.when(~F.col("_ok"), "malformed").when(F.coalesce(F.col("_c"), F.lit("false")) != "true", "open").when(missing, "missing field").when(low, "bad time").when(F.col("_b") <= F.col("_a"), "close not after start")
        .when(bad_number, "not a finite number").when(price, "price not positive").when(F.col("volume") < 0, "negative volume").when(F.col("high") < F.greatest("open", "close", "low"), "high too low").when(F.col("low") > F.least("open", "close"), "low too high")
    )
    out = out.withColumn("reason", reason)
    at = lambda c: F.when(F.col("reason").isNull(), F.timestamp_millis(F.col(c)))
    return out.withColumns({"time": at("_a"), "kline_close_time": at("_b")}).drop("_ok", "_a", "_b", "_c")


def articles(messages: DataFrame, value: str = "value") -> DataFrame:
    """messages plus an article's columns and reason; the time is that of publication, never the present."""
    g = lambda n: F.get_json_object(value, f"$.{n}")
    tags = F.from_json(g("coin_tags"), T.ArrayType(T.StringType()))
    out = messages.withColumns({**{n: g(n) for n in ("source_type", "source_name", "title", "url")}, "summary": F.coalesce(g("summary"), F.lit("")), "coin_tags": tags, "time": published(g("published_at"))})
    missing = F.lit(False)
    for c in ("source_type", "source_name", "title", "url", "published_at"):
        missing = missing | (F.coalesce(g(c), F.lit("")) == "")
    no_list = g("coin_tags").isNotNull() & (~F.trim(g("coin_tags")).startswith("[") | F.col("coin_tags").isNull())
    reason = F.when(~_is_object(F.col(value)), "malformed").when(missing, "missing field").when(no_list, "tags are no list").when(F.col("time").isNull(), "bad date")
    return out.withColumn("reason", reason).withColumn("coin_tags", F.coalesce("coin_tags", F.array().cast("array<string>")))


def good(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("reason").isNull()).drop("reason")


def dead_letters(rows: DataFrame, value: str = "value") -> DataFrame:
    """What was refused and why; open candles are not refused, only passed over."""
    return rows.where(F.col("reason").isNotNull() & (F.col("reason") != "open")).select(value, "reason")


def kline_messages(rows: DataFrame) -> DataFrame:
    """Candles as keyed JSON messages; a null stays a null."""
    return rows.select(F.col("symbol").alias("key"), F.to_json(F.struct(*[c for c in KLINE.names if c in rows.columns]), {"ignoreNullFields": "false"}).alias("value"))


def keyed_messages(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.col(key).alias("key"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
