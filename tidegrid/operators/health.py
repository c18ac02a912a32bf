"""Checks of the data's completeness and freshness, and the plan of repairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tags
from .islands import all_gaps, clipped, day_runs, join_ranges
from .joins import changed_since, days_below, differ, not_in, with_flag

FINDING = "area string, check string, status string, detail string, pending long, unit string, action string"
# The order of statuses, and of repairs.
LEVELS = ("OK", "WARN", "FAIL")
REPAIRS = ("market", "news", "retag", "score", "features", "signals", "reports")


def market_gaps(candles: DataFrame, since: str, until: str, grace_minutes: int = 2) -> DataFrame:
    """Missing ranges of minutes of each symbol from since to until less a grace."""
    kind = candles.schema["time"].dataType
    at = lambda s: F.lit(s).cast(kind)
    return all_gaps(candles, ["symbol"], "time", 60, at(since), at(until) - F.expr(f"interval {grace_minutes} minutes"))


def gap_finding(gaps: DataFrame, area: str, check: str, unit: str, action: str, fail_above: int) -> DataFrame:
    """One finding of all gaps: OK without any, WARN up to a bound of missing steps, FAIL above, with the largest named."""
    largest = F.max_by(F.concat_ws(" ", "symbol", F.col("start").cast("string"), F.lit("to"), F.col("end").cast("string")), F.col("n"))
    g = gaps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pending"), F.count("*").alias("k"), largest.alias("l"))
    status = F.when(F.col("pending") == 0, "OK").when(F.col("pending") <= fail_above, "WARN").otherwise("FAIL")
    return g.select(F.lit(area).alias("area"), F.lit(check).alias("check"), status.alias("status"), F.when(F.col("k") == 0, "complete").otherwise(F.format_string("%d gaps, largest %s", "k", "l")).alias("detail"), "pending", F.lit(unit).alias("unit"), F.lit(action).alias("action"))


def fetch_ranges(gaps: DataFrame, within_minutes: int = 1000) -> DataFrame:
    """Ranges to ask a service for: gaps less than a page apart are one."""
    return join_ranges(gaps.select("symbol", "start", "end"), ["symbol"], within_minutes * 60)


def news_gaps(articles: DataFrame, days: DataFrame, at_least: int, since: Column | None = None) -> DataFrame:
    """Runs of days on which a coin has too few articles. days: coin, day."""
    short = days_below(articles, days, "coin", "day", "time", "coin_tags", at_least)
    runs = day_runs(short, ["coin"], "day")
    return runs if since is None else clipped(runs, since)


def retag_candidates(articles: DataFrame, scores: DataFrame, keywords: dict[str, list[str]], types: list[str]) -> DataFrame:
    """Articles whose tags are no longer what their text gives, with the new tags and whether they have scores that go with the old."""
    new = articles.where(F.col("source_type").isin(types)).withColumn("new_tags", tags(F.concat_ws(" ", "title", "summary"), keywords))
    return with_flag(new.where(differ(F.col("coin_tags"), F.col("new_tags"))), scores, ["url", "time"], "scored")


def backlog(articles: DataFrame, scores: DataFrame) -> DataFrame:
    return not_in(articles.where(F.size("coin_tags") > 0), scores, ["url", "time"])


def rebuild_from(bars: DataFrame, features: DataFrame, news: DataFrame | None = None) -> DataFrame:
    """For each frequency the earliest bar that is missing or older than its inputs, and how many there are.

    bars: freq, symbol, bucket, changed (when candles came in). news: freq, bucket, changed, which touches every symbol's bar.
    """
    stale = changed_since(bars, features, ["freq", "symbol", "bucket"], "changed", "computed_at").select("freq", "symbol", "bucket")
    if news is not None:
        n = features.join(news.withColumnRenamed("changed", "_c"), ["freq", "bucket"]).where(F.col("_c") > F.col("computed_at")).select("freq", "symbol", "bucket")
        stale = stale.unionByName(n).distinct()
    return stale.groupBy("freq").agg(F.min("bucket").alias("rebuild_from"), F.count("*").alias("pending"))


def recency(table: DataFrame, time: str, keys: list[str], now: str, warn_minutes: int) -> DataFrame:
    """Minutes since each key's latest row, and whether that is too long."""
    kind = table.schema[time].dataType
    g = table.groupBy(*keys).agg(F.max(time).alias("latest"))
    lag = F.timestamp_diff("SECOND", F.col("latest"), F.lit(now).cast(kind)) / 60.0
    return g.withColumns({"minutes": F.round(lag, 1), "status": F.when(lag > warn_minutes, "WARN").otherwise("OK")})


def training_history(frame: DataFrame, min_train: int) -> DataFrame:
    """Labelled rows of each coin against what a model needs."""
    g = frame.groupBy("coin").agg(F.count("label").alias("n"))
    return g.withColumn("status", F.when(F.col("n") < min_train, "FAIL").otherwise("OK"))


def consumer_lag(offsets: DataFrame, bound: int) -> DataFrame:
    """Messages not yet read, of committed and end offsets by partition."""
    g = offsets.agg(F.coalesce(F.sum(F.greatest(F.col("end_offset") - F.coalesce("committed", F.lit(0)), F.lit(0))), F.lit(0)).alias("pending"))
    return g.withColumn("status", F.when(F.col("pending") > bound, "WARN").otherwise("OK"))


def progress_lag(progress: list[dict]) -> int:
    """The same from a streaming query's progress reports."""
    lag = 0
    for source in (progress[-1] if progress else {}).get("sources", []):
        end, latest = source.get("endOffset") or {}, source.get("latestOffset") or {}
        for topic, parts in latest.items() if isinstance(latest, dict) else ():
            lag += sum(max(0, n - (end.get(topic) or {}).get(p, 0)) for p, n in parts.items())
    return lag


def guarded(spark: SparkSession, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Findings of all checks; a check that breaks is one finding that fails, and the others still run."""
    out = spark.createDataFrame([], FINDING)
    for area, check in checks.items():
        try:
            rows = [r.asDict() for r in check().collect()]  # a check gives a handful of findings
            found = spark.createDataFrame([tuple(r.get(c) for c in out.columns) for r in rows], FINDING)
        except Exception as e:  # noqa: BLE001
            found = spark.createDataFrame([(area, "check", "FAIL", f"{type(e).__name__}: {e}"[:2000], None, None, None)], FINDING)
        out = out.unionByName(found)
    return out


def summary(findings: DataFrame) -> DataFrame:
    """How many findings of each status, and the worst."""
    place = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("status"))
    g = findings.agg(*[F.count_if(F.col("status") == x).alias(x.lower()) for x in LEVELS], F.max(place).cast("int").alias("_w"))
    return g.withColumn("worst", F.try_element_at(F.array(*[F.lit(x) for x in LEVELS]), F.col("_w"))).drop("_w")


def repair_plan(findings: list[dict], with_news: bool = True, with_reports: bool = False) -> list[str]:
    """Repairs in the order they build on each other. A repair brings those after it that read what it writes."""
    due = {f["action"] for f in findings if f.get("status") != "OK" and f.get("action")}
    if not with_news:
        due.discard("news")
    follow = {"market": ("features", "signals"), "news": ("retag", "score", "features", "signals"), "retag": ("score", "features", "signals"), "score": ("features", "signals"), "features": ("signals",)}
    for step in REPAIRS:
        if step in due:
            due.update(follow.get(step, ()))
    if not with_reports:
        due.discard("reports")
    return [s for s in REPAIRS if s in due]


def run_repairs(steps: list[str], tools: dict[str, Callable[[], object]]) -> list[tuple[str, str]]:
    """Runs the repairs one after the other; after one that fails, none that builds on it runs."""
    out: list[tuple[str, str]] = []
    for s in steps:
        try:
            tools[s]()
            out.append((s, "ok"))
        except Exception as e:  # noqa: BLE001
            out.append((s, f"failed: {e}"))
            out += [(r, "skipped") for r in steps[len(out) :]]
            break
    return out


def report_ages(files: DataFrame, now: str, most_hours: int) -> DataFrame:
    """Reports older than a bound, by the time their files changed; contents are not read."""
    age = F.timestamp_diff("SECOND", F.col("modificationTime"), F.lit(now).cast("timestamp")) / 3600.0
    return files.select("path", F.round(age, 1).alias("hours"), F.when(age > most_hours, "WARN").otherwise("OK").alias("status"))
