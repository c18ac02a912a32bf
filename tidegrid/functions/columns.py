"""Scalar expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(time: Column | str, seconds: int) -> Column:
    """Start of the bar that a time falls into; bars are aligned to 1970-01-01 00:00, whatever the session's zone for times without one."""
    return F.window(F.col(time) if isinstance(time, str) else time, f"{seconds} seconds")["start"]


def minutes_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later) / 60.0


def symbol_of(coin: Column) -> Column:
    return F.upper(F.replace(coin, F.lit("/"), F.lit("")))


def key_of(coin: Column) -> Column:
    return F.lower(F.split_part(coin, F.lit("/"), F.lit(1)))


def pair_of(symbol: Column, quote: str = "USDT") -> Column:
    """'btcusdt' as 'BTC/USDT'; null for what is not letters and digits."""
    plain = symbol_of(symbol)
    base = F.expr(f"left(upper(replace({_name(symbol)}, '/', '')), greatest(length(replace({_name(symbol)}, '/', '')) - {len(quote)}, 0))") if isinstance(symbol, str) else F.substring(plain, F.lit(1), F.greatest(F.length(plain) - len(quote), F.lit(0)))
    return F.when(~plain.rlike("^[A-Z0-9]+$"), None).when(plain.endswith(quote) & (F.length(plain) > len(quote)), F.concat(base, F.lit(f"/{quote}"))).otherwise(plain)


def _name(column: str) -> str:
    return f"`{column}`"


def tags(text: Column, keywords: dict[str, list[str]], default: str = "MARKET") -> Column:
    """Keys whose keywords occur as whole words, in the order given; [default] if none does. A null text has none."""
    import re

    found = [F.when(F.lower(text).rlike(r"\b(?:" + "|".join(re.escape(w.lower()) for w in words) + r")\b"), F.lit(k)) for k, words in keywords.items()]
    got = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    return F.when(F.size(got) > 0, got).otherwise(F.array(F.lit(default)))


def scoring_text(title: Column, summary: Column) -> Column:
    """'title. summary', or the title where there is no summary."""
    return F.when(F.coalesce(summary, F.lit("")) != "", F.concat(title, F.lit(". "), summary)).otherwise(title)


def plain_text(html: Column) -> Column:
    """Markup out by patterns, the five named references decoded, white space collapsed. For exact parsing see functions.text.clean_text."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def label(compound: Column, cut: float = 0.3) -> Column:
    return F.when(compound >= cut, "positive").when(compound <= -cut, "negative").otherwise("neutral")


def action(prob: Column, buy: float, sell: float) -> Column:
    return F.when(prob >= buy, "BUY").when(prob <= sell, "SELL").otherwise("HOLD")


def origin(model_version: Column) -> Column:
    return F.when(model_version.startswith("replay:"), "replayed").otherwise("live")


def version_name(freq: str, horizon: int, trained: Column) -> Column:
    return F.concat(F.lit(f"gbt-{freq}-h{horizon}-"), F.date_format(trained, "yyyyMMdd'T'HHmm"))


def age_text(minutes: Column) -> Column:
    return F.when(minutes.isNull(), "never").when(minutes < 60, F.format_string("%.0f min", minutes)).when(minutes < 48 * 60, F.format_string("%.1f h", minutes / 60)).otherwise(F.format_string("%.1f days", minutes / 1440))


def status(bad: Column, warn: Column) -> Column:
    return F.when(bad, "FAIL").when(warn, "WARN").otherwise("OK")


def finite(text: Column) -> Column:
    """A numeric string as double; null for what is no finite number."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def published(text: Column) -> Column:
    """A date in any of the forms that feeds use; what has no zone is UTC. Null if it is none, never the present."""
    plain = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", "")
    plain = F.regexp_replace(plain, r"\s(GMT|UTC|UT|Z)$", " +0000")
    forms = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyyMMdd'T'HHmmssX", "d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd HH:mm:ssXXX"]
    zoned = [F.try_to_timestamp(plain, F.lit(f)) for f in forms]
    naive = [F.try_to_timestamp(F.concat(plain, F.lit("+00:00")), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ssXXX")]
    day = F.try_to_timestamp(F.concat(plain, F.lit("T00:00:00+00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))
    return F.coalesce(*zoned, *naive, day)


def hour_angle(time: Column) -> tuple[Column, Column]:
    turn = F.hour(time) * (2 * 3.141592653589793 / 24)
    return F.sin(turn), F.cos(turn)
