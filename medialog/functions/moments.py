"""Date and time text, and wall-clock conversion."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(value: datetime | Column) -> Column:
    """A point in time as a literal. A datetime without a zone is UTC, wherever Python runs."""
    if isinstance(value, Column):
        return value
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.lit(value).cast("timestamp")


def rfc2822(ts: Column) -> Column:
    return F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _clock(seconds: Column) -> tuple[Column, Column, Column]:
    s = F.greatest(F.lit(0), F.floor(seconds + F.lit(0.5))).cast("bigint")
    return F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))


def feed_duration(seconds: Column) -> Column:
    """HH:MM:SS, hours always present."""
    h, m, s = _clock(seconds)
    hours = F.when(h < 10, _two(h)).otherwise(h.cast("string"))
    text = F.concat(hours, F.lit(":"), _two(m), F.lit(":"), _two(s))
    return F.when(seconds.isNotNull(), text)


def short_duration(seconds: Column) -> Column:
    """H:MM:SS, or M:SS below an hour."""
    h, m, s = _clock(seconds)
    tail = F.concat(F.lit(":"), _two(s))
    return F.when(
        seconds.isNotNull(),
        F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), _two(m), tail)).otherwise(
            F.concat(m.cast("string"), tail)
        ),
    )


# Upper limit in seconds, divisor and unit of relative times.
RELATIVE_STEPS = (
    (45, 1, "second"),
    (45 * 60, 60, "minute"),
    (22 * 3600, 3600, "hour"),
    (26 * 86400, 86400, "day"),
    (320 * 86400, 30 * 86400, "month"),
    (None, 365 * 86400, "year"),
)


def relative_time(ts: Column, now: Column) -> Column:
    """'3 minutes ago', 'in 2 days', 'just now'."""
    delta = (F.unix_micros(ts) - F.unix_micros(now)) / F.lit(1e6)
    size = F.abs(delta)

    def phrase(divisor: int, unit: str) -> Column:
        n = F.abs(F.floor(delta / divisor + F.lit(0.5))).cast("bigint")
        amount = F.concat(n.cast("string"), F.lit(" " + unit), F.when(n == 1, "").otherwise("s"))
        return F.when(delta < 0, F.concat(amount, F.lit(" ago"))).otherwise(F.concat(F.lit("in "), amount))

    out = phrase(*RELATIVE_STEPS[-1][1:])
    for limit, divisor, unit in reversed(RELATIVE_STEPS[:-1]):
        out = F.when(size < limit, phrase(divisor, unit)).otherwise(out)
    return F.when(ts.isNull(), "").when(size < 10, "just now").otherwise(out)


def to_local(ts: Column, zone: str) -> Column:
    """Wall-clock reading of an instant in ``zone``."""
    return F.from_utc_timestamp(ts, zone)


def to_instant(wall: Column, zone: str) -> Column:
    """Instant of a wall-clock reading in ``zone``."""
    return F.to_utc_timestamp(wall, zone)


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(to_local(ts, zone))


def local_midnight(day: Column, zone: str) -> Column:
    return to_instant(day.cast("timestamp"), zone)


def parse_local_input(text: Column, zone: str) -> Column:
    """Instant of 'YYYY-MM-DD[T ]HH:MM[:SS]' read in ``zone``; other ISO text is UTC."""
    shape = r"\A\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2})?\s*\z"
    parsed = F.try_to_timestamp(F.trim(text))
    return F.when(text.rlike(shape), to_instant(parsed, zone)).otherwise(parsed)


def local_input(ts: Column, zone: str) -> Column:
    return F.coalesce(F.date_format(to_local(ts, zone), "yyyy-MM-dd'T'HH:mm"), F.lit(""))
