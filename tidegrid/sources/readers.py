"""Scans of tables, files, topics and paged services, and the reads that a service or a dashboard asks for."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from ..config import validate_request
from ..operators.bars import latest

# The messages of the two topics.
KLINE = T.StructType([T.StructField(n, T.StringType()) for n in ("symbol", "exchange", "kline_start_time", "kline_close_time", "open", "high", "low", "close", "volume", "is_closed", "event_time")])
ARTICLE = T.StructType([T.StructField(n, T.StringType()) for n in ("source_type", "source_name", "title", "summary", "url", "published_at", "coin_tags", "ingested_at")])


def between(df: DataFrame, start: datetime | None, end: datetime | None, column: str = "time") -> DataFrame:
    """Rows of [start, end); a bound that is None is none. The filters reach the scan."""
    kind = df.schema[column].dataType
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start).cast(kind))
    if end is not None:
        df = df.where(F.col(column) < F.lit(end).cast(kind))
    return df


def read_candles(spark: SparkSession, path: str, symbols: list[str], start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    df = between(spark.read.parquet(path).where(F.col("symbol").isin(symbols)), start, end)
    return df.select("time", "symbol", *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])


def read_scores(spark: SparkSession, path: str, coins: list[str], start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    df = between(spark.read.parquet(path).where(F.col("coin").isin(coins)), start, end)
    return df.select("time", "url", "coin", F.col("finbert_compound").cast("double").alias("finbert_compound"), F.col("vader_compound").cast("double").alias("vader_compound"), "finbert_label")


def read_features(spark: SparkSession, path: str, freq: str, coins: list[str], columns: list[str], since: datetime | None = None) -> DataFrame:
    """Only the columns asked for, of one frequency, whose folder alone is read where the table is laid out by freq."""
    validate_request(freq=freq)
    df = between(spark.read.parquet(path).where((F.col("freq") == freq) & F.col("coin").isin(coins)), since, None, "bucket")
    return df.select(*columns)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """JSON reports under a path or pattern, with each one's file."""
    df = spark.read.json(path, multiLine=True)
    return df.withColumn("file", F.input_file_name())


def catalog(spark: SparkSession) -> DataFrame:
    """Tables, columns and types of the current database."""
    rows = [(t.name, c.name, c.dataType, c.nullable) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string, nullable boolean")


def file_ages(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path with their time of change; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def kafka(spark: SparkSession, servers: str, topic: str, group: str, streaming: bool = True, **options: str) -> DataFrame:
    """A topic from its beginning; value as text. Needs Spark's Kafka connector."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    opts = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "kafka.group.id": group} | options
    return reader.options(**opts).load().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "topic", "partition", "offset")


def message_files(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A folder of text files with a message a line, as a stream; it stands in for a topic."""
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)


def combined_stream(value: DataFrame, column: str = "value") -> DataFrame:
    """Messages of a combined candle stream: what lies under data.k, as text, in KLINE's columns. Others are left out."""
    k = lambda n: F.get_json_object(column, f"$.data.k.{n}")
    names = {"symbol": "s", "kline_start_time": "t", "kline_close_time": "T", "open": "o", "high": "h", "low": "l", "close": "c", "volume": "v", "is_closed": "x"}
    out = value.select(*[k(v).alias(n) for n, v in names.items()], F.lit("binance").alias("exchange"), F.get_json_object(column, "$.data.E").alias("event_time"))
    return out.where(F.col("symbol").isNotNull() & F.col("kline_start_time").isNotNull()).select(*KLINE.names)


class _Page(InputPartition):
    def __init__(self, key: str, start: int, end: int) -> None:
        super().__init__(start)
        self.key, self.start, self.end = key, start, end


class PagedSource(DataSource):
    """Rows of a service that is asked page by page over a range of time: spark.read.format("paged").options(...).

    Options: fetch, module:function giving fetch(key, start_ms, end_ms) -> rows for schema; keys, comma-separated;
    start_ms, end_ms; page_ms, how much one request covers; per_task, requests in one partition; schema. Every (key, range)
    is a partition of its own, so that a range that fails is asked for again alone.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagedReader(dict(self.options))

    def simpleStreamReader(self, schema: T.StructType) -> SimpleDataSourceStreamReader:
        return _PagedStream(dict(self.options))


def _function(name: str) -> Callable:
    import importlib

    module, _, attr = name.partition(":")
    return getattr(importlib.import_module(module), attr)


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.o = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[_Page]:
        start, end, page = int(self.o["start_ms"]), int(self.o["end_ms"]), int(self.o["page_ms"])
        step = page * int(self.o.get("per_task", 50))
        return [_Page(k, a, min(a + step, end)) for k in self.o["keys"].split(",") for a in range(start, end, step)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        fetch, page = _function(self.o["fetch"]), int(self.o["page_ms"])
        yield from pages(lambda a, b: fetch(partition.key, a, b), partition.start, partition.end, page)


class _PagedStream(SimpleDataSourceStreamReader):
    """The same, as time goes on: each batch asks for what came since the last one, whole pages only."""

    def __init__(self, options: dict) -> None:
        self.o = {k.lower(): v for k, v in options.items()}

    def initialOffset(self) -> dict:
        return {"ms": int(self.o["start_ms"])}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = min(int(self.o.get("end_ms", time.time() * 1000)), start["ms"] + int(self.o["page_ms"]) * int(self.o.get("per_task", 50)))
        return self.readBetweenOffsets(start, {"ms": end}), {"ms": end}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        fetch, page = _function(self.o["fetch"]), int(self.o["page_ms"])
        return iter([r for k in self.o["keys"].split(",") for r in pages(lambda a, b, k=k: fetch(k, a, b), start["ms"], end["ms"], page)])


def pages(fetch: Callable[[int, int], list[tuple]], start: int, end: int, page: int) -> Iterator[tuple]:
    """All rows of [start, end): a request covers at most `page`. A service may give fewer rows than lie in it, so the next
    request begins right after the latest row's time (its first column). Empty pages are passed over."""
    at = start
    while at < end:
        stop = min(at + page, end)
        rows = [r for r in fetch(at, stop) if at <= r[0] < stop]
        yield from rows
        at = max(r[0] for r in rows) + 1 if rows else stop


def pages_backwards(fetch: Callable[[int], list[tuple]], start: int, end: int) -> list[tuple]:
    """Rows of [start, end) of a service that gives the newest rows before a time: asked with ever earlier times."""
    out, at = [], end
    while at > start:
        rows = fetch(at)
        if not rows:
            break
        out += [r for r in rows if start <= r[0] < end]
        oldest = min(r[0] for r in rows)
        if oldest >= at:
            break
        at = oldest
    return out


class Backoff:
    """Delays that double from first to most; a success starts over. budget: seconds of waiting in all, None for no end."""

    def __init__(self, first: float, most: float, budget: float | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
        self.first, self.most, self.budget, self.sleep = first, most, budget, sleep
        self.next, self.spent = first, 0.0

    def wait(self) -> bool:
        """Waits; False if the budget doesn't allow another wait."""
        if self.budget is not None and self.spent + self.next > self.budget:
            return False
        self.sleep(self.next)
        self.spent += self.next
        self.next = min(self.next * 2, self.most)
        return True

    def reset(self) -> None:
        self.next, self.spent = self.first, 0.0


class Blocked(Exception):
    """A service refuses to answer for now."""


def with_key_rotation(ask: Callable[[str], list], keys: list[str]) -> list:
    """Asks with one key after the other until one isn't refused."""
    last: Blocked | None = None
    for k in keys:
        try:
            return ask(k)
        except Blocked as e:
            last = e
    raise last or Blocked("no key")


def windows(start: datetime, end: datetime, hours: int) -> list[tuple[datetime, datetime]]:
    out, at = [], start
    while at < end:
        out.append((at, min(at + timedelta(hours=hours), end)))
        at = out[-1][1]
    return out


def fetch_windows(fetch: Callable[[datetime, datetime], list], spans: list[tuple[datetime, datetime]], give_up_after: int = 3) -> tuple[list, list[tuple[datetime, datetime]]]:
    """Rows of all windows, and the windows that were refused; after so many refusals in a row it stops."""
    rows, refused, run = [], [], 0
    for a, b in spans:
        try:
            rows += fetch(a, b)
            run = 0
        except Blocked:
            refused.append((a, b))
            run += 1
            if run >= give_up_after:
                break
    return rows, refused


def rss_items(xml: str, seen: set[str], now: datetime | None = None) -> list[dict]:
    """Items of a feed whose url isn't seen yet; an item without a readable date gets the present time. Adds to seen."""
    import xml.etree.ElementTree as ET
    from email.utils import parsedate_to_datetime

    out = []
    for item in ET.fromstring(xml).iter("item"):
        url = (item.findtext("link") or "").strip()
        if not url or url in seen:
            continue
        seen.add(url)
        try:
            at = parsedate_to_datetime(item.findtext("pubDate") or "")
        except (TypeError, ValueError):
            at = now or datetime.now(UTC)
        out.append({"title": (item.findtext("title") or "").strip(), "summary": (item.findtext("description") or "").strip(), "url": url, "published_at": at.astimezone(UTC).isoformat()})
    return out


def gdelt_query(terms: list[str]) -> str:
    return "(" + " OR ".join(terms) + ")" if len(terms) > 1 else terms[0]


def gdelt_articles(body: str, seen: set[str]) -> list[dict]:
    out = []
    for a in json.loads(body).get("articles", []):
        if a.get("url") and a["url"] not in seen:
            seen.add(a["url"])
            out.append({"title": a.get("title", ""), "summary": "", "url": a["url"], "published_at": a.get("seendate", ""), "source_name": a.get("domain", "")})
    return out


def sources(which: str, known: dict[str, Callable]) -> dict[str, Callable]:
    """The pollers to run: all of them, or one by name."""
    if which != "all" and which not in known:
        raise ValueError(f"source must be all or of {sorted(known)}")
    return known if which == "all" else {which: known[which]}


# ---- reads for a service ----


def health(tables: dict[str, tuple[DataFrame, str]], now: str, bounds: dict[str, float]) -> DataFrame:
    """Latest time, minutes since and status of each stage. tables: stage to a table and its time column."""
    out = None
    for stage, (df, column) in tables.items():
        row = df.agg(F.max(F.col(column).cast("timestamp_ntz")).alias("latest")).select(F.lit(stage).alias("stage"), "latest")
        out = row if out is None else out.unionByName(row)
    lag = F.round(F.timestamp_diff("SECOND", F.col("latest"), F.lit(now).cast("timestamp_ntz")) / 60, 1)
    most = F.create_map(*[F.lit(x) for kv in bounds.items() for x in kv])
    out = out.withColumn("lag_minutes", lag)
    return out.withColumn("status", F.when(F.col("latest").isNull() | (F.col("lag_minutes") > most[F.col("stage")]), "stale").otherwise("ok"))


def signals_latest(signals: DataFrame) -> DataFrame:
    return latest(signals, ["symbol"], ["bucket"])


def signals_history(signals: DataFrame, symbol: str, now: str, hours: int) -> DataFrame:
    validate_request(hours=hours, name=symbol)
    cut = F.lit(now).cast(signals.schema["bucket"].dataType) - F.expr(f"interval {hours} hours")
    return signals.where((F.col("symbol") == symbol) & (F.col("bucket") >= cut))


def news_recent(scores: DataFrame, articles: DataFrame, limit: int, coin: str | None = None) -> DataFrame:
    """The newest scores, of one coin if named, with their articles: the limit comes before the join."""
    validate_request(limit=limit)
    some = scores if coin is None else scores.where(F.col("coin") == coin)
    top = some.orderBy(F.desc("time"), "url", "coin").limit(limit)
    return top.join(articles.select("url", "time", "title", "source_name"), ["url", "time"], "left")


def meta(config: dict) -> dict:
    """What a client needs to know of the configuration."""
    s = config["signal_model"]
    return {"coins": [c["symbol"] for c in config["coins"]], "targets": s["targets"], "input_coins": s["input_coins"], "frequencies": config["features"]["frequencies"], "thresholds": {"buy": s["buy_threshold"], "sell": s["sell_threshold"]}, "fee_bps": s["backtest"]["fee_bps"]}
