"""Numbers, dates and JSON as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS = 60_000
DAY_MS = 86_400_000


def softmax_entropy(scores: Column) -> Column:
    """Normalised entropy of the softmax of an array of scores; 0 with fewer than two."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    raw = F.aggregate(F.transform(weights, lambda w: w / total), F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.ln(p)).otherwise(0.0))
    return F.when(F.size(scores) < 2, F.lit(0.0)).otherwise(raw / F.ln(F.size(scores).cast("double")))


def confidence_level(top1: Column, entropy: Column, low_top1: float, low_entropy: float, high_top1: float, high_entropy: float) -> Column:
    low = (top1 <= 0) | (top1 < low_top1) | (entropy > low_entropy)
    return F.when(low, "low").when((top1 >= high_top1) & (entropy <= high_entropy), "high").otherwise("medium")


def gain(grade: Column) -> Column:
    return F.pow(F.lit(2.0), grade) - 1


def discount(rank: Column) -> Column:
    """rank from 0."""
    return F.log2(rank + 2)


def points(uncached: Column, cached: Column, output: Column, c: float = 0.25, o: float = 4.0) -> Column:
    return uncached + c * cached + o * output


def ratios(price_in: float | None, price_cached: float | None, price_out: float | None, c: float = 0.25, o: float = 4.0) -> tuple[float, float]:
    """Cost ratios from prices where all are usable, else the defaults."""
    if price_in and price_in > 0 and price_cached is not None and price_cached >= 0 and price_out is not None and price_out >= 0:
        return price_cached / price_in, price_out / price_in
    return c, o


def tone(trust: Column, normal: int = 60, close: int = 100, deep: int = 150) -> Column:
    return F.when(trust >= deep, "deep").when(trust >= close, "close").when(trust >= normal, "normal").otherwise("guarded")


def civil(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int"))


def civil_days(date: Column) -> Column:
    return F.unix_date(date).cast("long")


def hhmm(text: Column) -> Column:
    """``H:MM`` or ``HH:MM`` (full-width colon too) as ``HH:MM``; null if it isn't a time."""
    t = F.replace(F.trim(text), F.lit("："), F.lit(":"))
    ok = t.rlike(r"^([01]?[0-9]|2[0-3]):[0-5][0-9]$")
    return F.when(ok, F.lpad(t, 5, "0"))


def minute_of(text: Column) -> Column:
    t = hhmm(text)
    return F.substring(t, 1, 2).cast("int") * 60 + F.substring(t, 4, 2).cast("int")


def due_ms(text: Column) -> Column:
    """ISO date-time with an offset as milliseconds; null if it can't be read."""
    return F.unix_millis(F.try_to_timestamp(text))


def local_ms(ms: Column, offset_minutes: int) -> Column:
    return ms + offset_minutes * MINUTE_MS


def local_date(ms: Column, offset_minutes: int = 0) -> Column:
    return F.date_from_unix_date(F.floor(local_ms(ms, offset_minutes) / DAY_MS).cast("int"))


def local_minute(ms: Column, offset_minutes: int = 0) -> Column:
    return F.floor(F.pmod(local_ms(ms, offset_minutes), F.lit(DAY_MS)) / MINUTE_MS).cast("int")


def in_world_date(ms: Column, year_offset: int, offset_minutes: int = 0) -> Column:
    d = local_date(ms, offset_minutes)
    return F.concat_ws("-", F.lpad((F.year(d) - year_offset).cast("string"), 4, "0"), F.date_format(d, "MM"), F.date_format(d, "dd"))


def day_month(text: Column) -> Column:
    """MM-DD from ``MM-DD`` or ``YYYY-MM-DD`` where it is a day of a leap year; else null."""
    md = F.regexp_extract(text, r"^(?:[0-9]{4}-)?([0-9]{2}-[0-9]{2})$", 1)
    return F.when(F.try_to_date(F.concat(F.lit("2000-"), md)).isNotNull(), md)


def in_quiet_hours(minute: Column, start: int, end: int) -> Column:
    """[start, end) in minutes of the day, across midnight if start is later; equal: never."""
    if start == end:
        return F.lit(False)
    return (minute >= start) & (minute < end) if start < end else (minute >= start) | (minute < end)


def too_soon(last: Column, now: Column, gap_minutes: int) -> Column:
    return F.coalesce(now - last < gap_minutes * MINUTE_MS, F.lit(False))


def touches(span_a: Column, from_a: Column, to_a: Column, span_b: Column, from_b: Column, to_b: Column) -> Column:
    """Two units of one span that lie next to each other."""
    return (span_a == span_b) & ((to_a + 1 == from_b) | (to_b + 1 == from_a))
