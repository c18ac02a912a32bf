"""Sources, sinks and streams, on folders of their own."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.functions import columns as C
from tidegrid.functions.text import clean, lexicon_scorer, scorer_udf
from tidegrid.operators import bars, features, validate
from tidegrid.sources import readers, sinks
from tidegrid.streaming import ingest

T0 = datetime(2024, 1, 1)
m = lambda n: T0 + timedelta(minutes=n)
CANDLES = T.StructType([T.StructField(c, T.StringType()) for c in ("symbol", "exchange")] + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")] + [T.StructField("time", T.TimestampType()), T.StructField("kline_close_time", T.TimestampType())])


def message(k, **more):
    return json.dumps({"symbol": "BTCUSDT", "exchange": "x", "kline_start_time": 1704067200000 + 60000 * k, "kline_close_time": 1704067259999 + 60000 * k, "open": 1, "high": 99, "low": 0.5, "close": 2 + k, "volume": 1, "is_closed": True} | more)


def test_keyed_store(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("freq", T.StringType()), T.StructField("v", T.StringType()), T.StructField("t", T.TimestampNTZType())])
    store = sinks.KeyedStore(spark, f"file://{tmp_path}/s", ["k", "freq"], schema, partition="freq")
    rows = lambda *r: spark.createDataFrame([(k, f, v, m(k)) for k, f, v in r], schema)
    assert store.read().count() == 0 and store.upsert(rows((1, "1h", "a"), (2, "4h", "b"))) == 2
    before = store.state()["folders"]
    assert store.upsert(rows((1, "1h", "A"), (3, "1h", "c"))) == 2
    after = store.state()["folders"]
    assert before["4h"] == after["4h"] and before["1h"] != after["1h"]
    assert {(r.k, r.v) for r in store.read().collect()} == {(1, "A"), (2, "b"), (3, "c")}
    assert store.insert_if_absent(rows((1, "1h", "z"), (4, "4h", "d"), (4, "4h", "e")), ["v"]) == 1
    assert {(r.k, r.v) for r in store.read(["4h"]).collect()} == {(2, "b"), (4, "d")}
    assert store.insert_if_absent(rows((4, "4h", "x")), ["v"]) == 0 and store.watermarks("freq", "t") == {"1h": m(3), "4h": m(4)}
    assert store.migrate(T.StructType([*schema, T.StructField("w", T.DoubleType())])) == ["w"]
    assert {r.w for r in store.read().collect()} == {None}
    store.upsert(rows((5, "1h", "f")).withColumn("w", F.lit(1.5)))
    assert store.read().where("w is not null").count() == 1
    with pytest.raises(ValueError):
        store.migrate(T.StructType([]))
    with store.lock("x"):
        with pytest.raises(sinks.LockedError), store.lock("x"):
            pass
    with store.lock("x"):
        pass
    a, b = store.start_run("full", None), store.start_run("incremental", m(0))
    store.finish_run(a, "ok", 7, None)
    assert {(r.run == a, r.status, r.rows) for r in store.runs().collect()} == {(True, "ok", 7), (False, "running", None)} and a != b


def test_retag(spark, tmp_path):
    art = T.StructType([T.StructField("url", T.StringType()), T.StructField("time", T.TimestampNTZType()), T.StructField("coin_tags", T.ArrayType(T.StringType()))])
    sc = T.StructType([T.StructField("url", T.StringType()), T.StructField("time", T.TimestampNTZType()), T.StructField("coin", T.StringType())])
    a, s = sinks.KeyedStore(spark, f"file://{tmp_path}/a", ["url", "time"], art), sinks.KeyedStore(spark, f"file://{tmp_path}/s", ["url", "time", "coin"], sc)
    a.upsert(spark.createDataFrame([("u", m(0), ["X"]), ("w", m(1), ["Y"])], art))
    s.upsert(spark.createDataFrame([("u", m(0), "X"), ("w", m(1), "Y")], sc))
    sinks.retag(a, s, spark.createDataFrame([("u", m(0), ["Z"])], "url string, time timestamp_ntz, new_tags array<string>"))
    assert {(r.url, tuple(r.coin_tags)) for r in a.read().collect()} == {("u", ("Z",)), ("w", ("Y",))} and [r.url for r in s.read().collect()] == ["w"]


def test_feature_run(spark, tmp_path):
    from tidegrid.config import parse_feature_config

    cfg = parse_feature_config({"frequencies": ["1h"], "rolling_short_bars": 2, "rolling_long_bars": 4, "incremental_lookback_bars": 2, "table": "f", "news_streams": {"btc": "BTC/USDT"}}, [{"symbol": "BTC/USDT"}])
    candles = lambda n: spark.createDataFrame([(m(i), "BTCUSDT", 1.0, 1.0, 1.0, 1.0 + i % 7, 1.0) for i in range(n)], "time timestamp, symbol string, open double, high double, low double, close double, volume double")
    scores = spark.createDataFrame([(m(90), "u", "BTC/USDT", 0.5, 0.1, "positive")], "time timestamp, url string, coin string, finbert_compound double, vader_compound double, finbert_label string")
    store = sinks.KeyedStore(spark, f"file://{tmp_path}/f", ["symbol", "freq", "bucket"], features.feature_schema(("btc",)), partition="freq")
    assert features.run_once(cfg, candles(600), scores, store) == 10
    assert features.run_once(cfg, candles(720), scores, store) == 5  # the last bar, two before it, and two new ones
    whole = features.build_features(candles(720), scores, ("1h",), 2, 4, {"BTCUSDT": "BTC/USDT"}, {"btc": "BTC/USDT"})
    key = lambda r: r.bucket
    assert [tuple(r) for r in sorted(store.read().collect(), key=key)] == [tuple(r) for r in sorted(whole.collect(), key=key)]
    assert sorted(r.mode for r in store.runs().collect()) == ["full", "incremental"]


def test_reports_and_scans(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", True), (2, "b", False)], "n int, s string, b boolean")
    sinks.write_report(spark, {"t": df}, {"when": T0, "bad": float("nan"), "n": 1}, f"file://{tmp_path}/r")
    back = readers.read_csv(spark, f"file://{tmp_path}/r/t")
    assert [f.dataType.typeName() for f in back.schema] == ["integer", "string", "boolean"] and back.count() == 2
    assert readers.read_reports(spark, f"file://{tmp_path}/r/*.json").first().when == "2024-01-01T00:00:00"
    assert readers.file_ages(spark, f"file://{tmp_path}/r").count() >= 2
    assert sinks.sample(df, 1).first().n == 2
    df.write.partitionBy("s").parquet(f"{tmp_path}/p")
    spark.read.parquet(f"{tmp_path}/p").createOrReplaceTempView("report_view")
    assert {r.column for r in readers.catalog(spark).where("table = 'report_view'").collect()} == {"n", "s", "b"}


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    rows = [(m(i), "1h" if i % 2 else "4h", "BTC/USDT", 1.0, 2.0) for i in range(10)]
    spark.createDataFrame(rows, "bucket timestamp_ntz, freq string, coin string, close double, other double").write.partitionBy("freq").parquet(f"{tmp_path}/f")
    df = readers.read_features(spark, f"{tmp_path}/f", "1h", ["BTC/USDT"], ["bucket", "close"], m(4))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 3 and "PartitionFilters: [isnotnull(freq" in plan and "other" not in plan and "GreaterThanOrEqual(bucket" in plan


def fetch(key, start, end):
    """A service with a row a minute and a hole."""
    return [(t, key) for t in range(start - start % 60000, end + 60000, 60000) if not 600_000 <= t < 1_200_000]


def test_paged_source(spark):
    import sys

    sys.modules["paged_service"] = sys.modules[__name__]
    r = readers._PagedReader({"fetch": "paged_service:fetch", "keys": "A,B", "start_ms": "0", "end_ms": "3000000", "page_ms": "300000", "per_task": "2"})
    parts = r.partitions()
    got = [x for p in parts for x in r.read(p)]
    assert len(parts) == 10 and len(got) == len(set(got)) == 2 * 40
    assert readers.PagedSource.name() == "paged"
    s = readers._PagedStream({"fetch": "paged_service:fetch", "keys": "A", "start_ms": "0", "end_ms": "900000", "page_ms": "300000", "per_task": "2"})
    rows, end = s.read(s.initialOffset())
    assert end == {"ms": 600_000} and len(list(rows)) == 10 and len(list(s.read(end)[0])) == 0


def test_pollers():
    waits = []
    b = readers.Backoff(45, 240, budget=480, sleep=waits.append)
    while b.wait():
        pass
    assert waits == [45, 90, 180] and b.spent == 315
    feed = "<rss><channel><item><title>A</title><link>u1</link><pubDate>Mon, 05 Feb 2024 10:30:00 GMT</pubDate></item><item><title>B</title><link>u1</link></item><item><link>u2</link><pubDate>?</pubDate></item></channel></rss>"
    seen: set[str] = set()
    items = readers.rss_items(feed, seen, datetime(2024, 1, 1).astimezone())
    assert [i["url"] for i in items] == ["u1", "u2"] and items[0]["published_at"].startswith("2024-02-05T10:30") and readers.rss_items(feed, seen) == []
    assert readers.gdelt_query(["a", "b"]) == "(a OR b)" and len(readers.gdelt_articles('{"articles": [{"url": "x"}, {"url": "x"}]}', set())) == 1
    spans = readers.windows(T0, T0 + timedelta(hours=8), 3)
    assert [(b - a).seconds // 3600 for a, b in spans] == [3, 3, 2]

    def blocked(a, b):
        raise readers.Blocked

    assert len(readers.fetch_windows(blocked, spans * 3)[1]) == 3
    calls = []

    def ask(key):
        calls.append(key)
        if key == "a":
            raise readers.Blocked
        return [1]

    assert readers.with_key_rotation(ask, ["a", "b"]) == [1] and calls == ["a", "b"]
    data = list(range(0, 100, 7))
    assert sorted(r[0] for r in readers.pages_backwards(lambda t: [(x,) for x in data if x < t][-4:], 20, 90)) == [x for x in data if 20 <= x < 90]
    with pytest.raises(ValueError):
        readers.sources("x", {"rss": None})


def test_candle_stream_with_dead_letters_and_restart(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.txt").write_text("\n".join([message(0), message(1), message(1, close=9), message(2, is_closed=False), message(3, volume=-1), "broken"]))
    store = sinks.KeyedStore(spark, f"file://{tmp_path}/c", ["symbol", "time"], CANDLES)
    counts: dict = {}
    run = lambda: ingest.ingest_candles(readers.message_files(spark, str(inbox)), store, f"file://{tmp_path}/dead", f"file://{tmp_path}/cp", counts=counts).awaitTermination()
    run()
    assert {(r.time, r.close) for r in store.read().collect()} == {(m(0), 2.0), (m(1), 3.0)}
    assert counts == {"read": 6, "partial": 1, "malformed": 2, "written": 2, "duplicates": 1}
    assert sorted(r.reason for r in spark.read.parquet(f"{tmp_path}/dead").collect()) == ["malformed", "negative volume"]
    (inbox / "b.txt").write_text("\n".join([message(1), message(5)]))
    run()
    run()
    assert store.read().count() == 3


def test_live_bars_equal_batch_bars(spark, tmp_path):
    ticks = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("time"), F.col("value").alias("price"), F.col("event_id").alias("seq"))
    ticks.repartitionByRange(3, "time").sortWithinPartitions("time").write.parquet(f"{tmp_path}/t")
    stream = spark.readStream.schema(ticks.schema).parquet(f"{tmp_path}/t")
    q = ingest.live_bars(ingest.unique(stream, ["seq"], "time", "2 days").select("symbol", "time", "price", "seq"), "4 hours", None).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = bars.time_window_bars(ticks, "4 hours")
    want = {tuple(r) for r in batch.collect()}
    # The stream holds back what could still change, and says nothing else.
    assert got <= want and len(got) > 0.8 * len(want)


def test_articles_are_scored_and_drained(spark, tmp_path):
    store = sinks.KeyedStore(spark, f"file://{tmp_path}/s", ["url", "coin"], T.StructType([T.StructField("url", T.StringType()), T.StructField("coin", T.StringType()), T.StructField("finbert_label", T.StringType()), T.StructField("finbert_compound", T.DoubleType())]))
    arts = spark.createDataFrame([(m(i), f"u{i}", ["A", "B"], "s", "good good" if i % 2 else "") for i in range(7)], "time timestamp, url string, coin_tags array<string>, source_name string, text string")
    score = scorer_udf(lexicon_scorer(frozenset(["good"]), frozenset(["bad"])))
    todo = lambda n: arts.join(store.read().select("url"), "url", "left_anti").orderBy(F.desc("time")).limit(n)
    n = ingest.drain(todo, lambda df: ingest.scored(df, score, "text").select("url", "coin", "finbert_label", "finbert_compound"), store, ["finbert_label"], 3)
    assert n == 14 and {(r.url, r.finbert_label) for r in store.read().collect() if r.url in ("u0", "u1")} == {("u0", "neutral"), ("u1", "positive")}


def test_supervision():
    class Query:
        def __init__(self, bad):
            self.bad = bad

        def awaitTermination(self):
            if self.bad:
                raise RuntimeError

    starts = iter([Query(True), Query(True), Query(False)])
    waits = []
    ingest.supervise(lambda: next(starts), sleep=waits.append, clock=lambda: 0.0)
    assert waits == [5, 10]
    with pytest.raises(RuntimeError):
        ingest.supervise(lambda: Query(True), sleep=waits.append, clock=lambda: 0.0)
    tries = []

    def action():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "ok"

    assert ingest.retried(action, backoff=readers.Backoff(1, 4, sleep=lambda s: None)) == "ok"
    assert ingest.every(30, lambda: 1 / 0, rounds=2, sleep=lambda s: None) == 2
    with pytest.raises(ValueError):
        ingest.every(5, lambda: None)


def test_scalar_functions(spark):
    d = spark.createDataFrame([("Mon, 05 Feb 2024 10:30:00 GMT",), ("2024-02-05T10:30:00.123456Z",), ("20240205T103000Z",), ("2024-02-05",), ("x",), (None,)], "s string")
    got = [r.p for r in d.select(C.published(F.col("s")).alias("p")).collect()]
    assert got[0] == datetime(2024, 2, 5, 10, 30) and got[1].microsecond == 123456 and got[2] == got[0] and got[3] == datetime(2024, 2, 5) and got[4:] == [None, None]
    t = spark.createDataFrame([("Bitcoin's ETH",), ("bethel",), ("",), (None,)], "s string").select(C.tags(F.col("s"), {"BTC/USDT": ["bitcoin", "btc"], "ETH/USDT": ["eth"]}).alias("t"))
    assert [r.t for r in t.collect()] == [["BTC/USDT", "ETH/USDT"], ["MARKET"], ["MARKET"], ["MARKET"]]
    assert clean("<p>a&amp;b</p><b>c</b>  d") == "a&b c d" and clean(None) == ""
    x = spark.createDataFrame([(0.55, "replay:1"), (0.45, "gbt"), (0.5, "gbt")], "p double, v string")
    assert [(r.a, r.o) for r in x.select(C.action(F.col("p"), 0.55, 0.45).alias("a"), C.origin(F.col("v")).alias("o")).collect()] == [("BUY", "replayed"), ("SELL", "live"), ("HOLD", "live")]
    k = validate.kline_messages(spark.createDataFrame([("A", None)], "symbol string, open double")).first()
    assert k.key == "A" and json.loads(k.value) == {"symbol": "A", "open": None}
    raw = json.dumps({"stream": "s", "data": {"E": 5, "k": {"s": "A", "t": 1, "T": 2, "o": "1", "h": "1", "l": "1", "c": "1", "v": "1", "x": True}}})
    c = readers.combined_stream(spark.createDataFrame([(raw,), ("{}",), ("no",)], "value string")).collect()
    assert len(c) == 1 and c[0].is_closed == "true"


def test_a_service_that_cuts_its_pages_loses_no_row():
    have = [(m * 60_000,) for m in range(3000)]
    calls = []

    def fetch(a, b):
        calls.append((a, b))
        return [r for r in have if a <= r[0] < b][:1000]

    assert list(readers.pages(fetch, 0, 3000 * 60_000, 1500 * 60_000)) == have
    assert len(calls) < 6
    assert list(readers.pages(lambda a, b: [], 0, 10, 3)) == []


def test_markup_cleaning_leaves_out_scripts_and_the_like():
    from tidegrid.functions.text import clean

    assert clean("Hello <script>var x=1;</script><style>p{}</style><template><b>no</b></template><b>world</b> <!-- c -->&amp;") == "Hello world &"
    assert clean("<ruby>a<rt>b</rt></ruby> <script>1") == "a" and clean(None) == ""
