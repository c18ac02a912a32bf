"""Streams: validated ingestion with dead letters, live bars, deduplication, scoring, and a supervisor."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import validate
from ..operators.bars import time_window_bars
from ..sources.readers import Backoff
from ..sources.sinks import KeyedStore


def retried(action: Callable[[], object], attempts: int = 5, backoff: Backoff | None = None) -> object:
    """Tries again after growing delays; the last error is raised, so that the batch is not committed."""
    backoff = backoff or Backoff(1, 30)
    for k in range(attempts):
        try:
            return action()
        except Exception:  # noqa: BLE001
            if k == attempts - 1 or not backoff.wait():
                raise
    return None


def ingest(messages: DataFrame, check: Callable[[DataFrame], DataFrame], store: KeyedStore, order: list[str], dead_path: str, checkpoint: str, available_now: bool = True, every: str = "10 seconds", counts: dict | None = None) -> StreamingQuery:
    """Messages to a keyed table: each batch is validated, good rows are inserted if absent, refused ones are written with their
    reason, and only then the offsets are committed. A batch that runs twice changes nothing the second time."""

    def batch(df: DataFrame, number: int) -> None:
        rows = check(df).persist()
        try:
            fresh = validate.good(rows).select(*[F.col(f.name).cast(f.dataType) for f in store.schema])
            written = retried(lambda: store.insert_if_absent(fresh, order))
            # A folder for each batch, written over if the batch comes again.
            validate.dead_letters(rows).write.mode("overwrite").parquet(f"{dead_path}/batch={number}")
            if counts is not None:
                n = rows.agg(F.count("*"), F.count_if(F.col("reason") == "open"), F.count_if(F.col("reason").isNotNull() & (F.col("reason") != "open"))).first()
                for k, v in {"read": n[0], "partial": n[1], "malformed": n[2], "written": written, "duplicates": n[0] - n[1] - n[2] - written}.items():
                    counts[k] = counts.get(k, 0) + v
        finally:
            rows.unpersist()

    writer = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def ingest_candles(messages: DataFrame, store: KeyedStore, dead_path: str, checkpoint: str, **options) -> StreamingQuery:
    return ingest(messages, validate.candles, store, ["kline_close_time", "close"], dead_path, checkpoint, **options)


def ingest_articles(messages: DataFrame, store: KeyedStore, dead_path: str, checkpoint: str, **options) -> StreamingQuery:
    return ingest(messages, validate.articles, store, ["source_name", "title"], dead_path, checkpoint, **options)


def unique(rows: DataFrame, keys: list[str], time_col: str, within: str) -> DataFrame:
    """A stream's rows, each key once within a time; the state is bounded by the watermark."""
    return rows.withWatermark(time_col, within).dropDuplicatesWithinWatermark(keys)


def live_bars(ticks: DataFrame, length: str, late: str | None, slide: str | None = None) -> DataFrame:
    """Candles of a stream of ticks; in append mode a bar comes once its time and the delay have passed, never half formed.

    late: how late rows may come; None if ticks have a watermark already.
    """
    return time_window_bars(ticks if late is None else ticks.withWatermark("time", late), length, slide)


def scored(articles: DataFrame, scorer, text: str, coins: str = "coin_tags") -> DataFrame:
    """A row for each article and coin with the scorer's values. scorer: functions.text.scorer_udf()."""
    s = articles.withColumn("_s", scorer(F.col(text)))
    return s.select("time", "url", F.explode(coins).alias("coin"), "source_name", *[F.col(f"_s.{n}").alias(f"finbert_{n}") for n in ("positive", "negative", "neutral", "compound", "label")])


def drain(todo: Callable[[int], DataFrame], score: Callable[[DataFrame], DataFrame], store: KeyedStore, order: list[str], batch: int = 16, limit: int | None = None) -> int:
    """Scores what is unscored, newest first, batch after batch, until nothing is left. How many rows were written."""
    total = rounds = 0
    while limit is None or rounds < limit:
        rows = todo(batch)
        if rows.isEmpty():
            break
        n = store.insert_if_absent(score(rows), order)
        total, rounds = total + n, rounds + 1
        if not n:
            break
    return total


def supervise(start: Callable[[], StreamingQuery], first: float = 5, most: float = 60, crashes: int = 5, within: float = 600, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
    """Runs a query until it ends by itself; starts it again after a crash, with growing delays; gives up when it crashes too often in a time."""
    backoff, times = Backoff(first, most, sleep=sleep), []
    while True:
        begun = clock()
        try:
            start().awaitTermination()
            return
        except Exception:  # noqa: BLE001
            now = clock()
            times = [t for t in times if now - t < within] + [now]
            if len(times) >= crashes:
                raise
            if now - begun > within:
                backoff.reset()
            backoff.wait()


def every(seconds: float, job: Callable[[], object], rounds: int | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> int:
    """Runs a job every so many seconds (at least 30), each start a step after the one before; an error is left to the next round. How many failed."""
    if seconds < 30:
        raise ValueError("every must be at least 30 seconds")
    failed = done = 0
    while rounds is None or done < rounds:
        begun = clock()
        try:
            job()
        except Exception:  # noqa: BLE001
            failed += 1
        done += 1
        if rounds is None or done < rounds:
            sleep(max(0.0, seconds - (clock() - begun)))
    return failed
