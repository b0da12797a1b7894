"""Reporting ranges and chart buckets, by calendar arithmetic in the instance's zone.

Ranges are half-open, ``[frm, to)``. Bucket edges are local midnights, so a day may have 23
or 25 hours and adjacent buckets share their edge.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.functions.moments import instant, local_date, local_midnight

# Selectable ranges in days; None is all time.
RANGE_DAYS = {"7d": 7, "30d": 30, "90d": 90, "all": None}
DEFAULT_RANGE = "30d"
MAX_BUCKETS = 92


@dataclass(frozen=True)
class TimeRange:
    """Bounds as naive UTC datetimes; all None for all time."""

    key: str
    days: int | None
    frm: datetime | None
    to: datetime | None
    prev_from: datetime | None


def time_range(key: str | None, now: datetime, zone: str) -> TimeRange:
    """Resolve a range key; an unknown one means the default."""
    key = key if key in RANGE_DAYS else DEFAULT_RANGE
    days = RANGE_DAYS[key]
    if days is None:
        return TimeRange(key, None, None, None, None)
    tz = ZoneInfo(zone)
    today = now.replace(tzinfo=timezone.utc).astimezone(tz).date()

    def midnight(offset: int) -> datetime:
        day = today + timedelta(days=offset)
        local = datetime(day.year, day.month, day.day, tzinfo=tz)
        return local.astimezone(timezone.utc).replace(tzinfo=None)

    return TimeRange(key, days, midnight(1 - days), midnight(1), midnight(1 - 2 * days))


def range_columns(key: str, now: Column, zone: str) -> dict[str, Column]:
    """The same bounds as columns, for a ``now`` that differs by row."""
    key = key if key in RANGE_DAYS else DEFAULT_RANGE
    days = RANGE_DAYS[key]
    if days is None:
        empty = F.lit(None).cast("timestamp")
        return {"range_from": empty, "range_to": empty, "prev_from": empty}
    today = local_date(now, zone)
    return {
        "range_from": local_midnight(F.date_add(today, 1 - days), zone),
        "range_to": local_midnight(F.date_add(today, 1), zone),
        "prev_from": local_midnight(F.date_add(today, 1 - 2 * days), zone),
    }


def in_range(col: Column, frm=None, to=None) -> Column | None:
    """Half-open test, or None when neither bound is given."""
    test = None
    if frm is not None:
        test = col >= instant(frm)
    if to is not None:
        upper = col < instant(to)
        test = upper if test is None else test & upper
    return test


def calendar_buckets(bounds: DataFrame, zone: str, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Chart buckets of a one-row frame ``(frm, to)``: days, else weeks, else calendar months.

    Returns idx, bucket_key (first local day), label, start_at, end_at, next_key. No bound or
    no full day gives no bucket. The last edge is pinned to ``to``.
    """
    first, last = F.col("first_day"), F.col("last_day")
    n = F.date_diff(last, first)
    # Branches may be evaluated before they are chosen, so every sequence must run forwards.
    last_start = F.greatest(first, F.date_sub(last, 1))
    by_day = F.sequence(first, last_start, F.expr("INTERVAL 1 DAY"))
    by_week = F.sequence(first, last_start, F.expr("INTERVAL 7 DAY"))
    next_month = F.add_months(F.trunc(first, "MM"), 1)
    by_month = F.when(
        next_month <= last_start,
        F.concat(F.array(first), F.sequence(next_month, F.greatest(next_month, last_start), F.expr("INTERVAL 1 MONTH"))),
    ).otherwise(F.array(first))
    width = F.when(n <= max_buckets, "day").when(F.ceil(n / 7) <= max_buckets, "week").otherwise("month")

    days = bounds.select(
        local_date(F.col("frm"), zone).alias("first_day"), local_date(F.col("to"), zone).alias("last_day")
    ).where(n > 0)
    edges = days.select(
        "last_day",
        width.alias("width"),
        F.when(width == "day", by_day).when(width == "week", by_week).otherwise(by_month).alias("starts"),
    )
    rows = edges.select(
        "width",
        F.posexplode(
            F.arrays_zip(
                F.col("starts").alias("s"),
                F.concat(F.slice("starts", 2, F.size("starts")), F.array("last_day")).alias("e"),
            )
        ).alias("idx", "edge"),
    ).select("width", "idx", F.col("edge.s").alias("bucket_key"), F.col("edge.e").alias("next_key"))
    label = F.when(F.col("width") == "month", F.date_format("bucket_key", "MMM yyyy")).otherwise(
        F.date_format("bucket_key", "d MMM")
    )
    return rows.select(
        "idx",
        "bucket_key",
        # British short form of the month.
        F.regexp_replace(label, "Sep", "Sept").alias("label"),
        local_midnight(F.col("bucket_key"), zone).alias("start_at"),
        local_midnight(F.col("next_key"), zone).alias("end_at"),
        "next_key",
    )


def bucket_days(buckets: DataFrame) -> DataFrame:
    """Local day to bucket index, so that facts meet buckets by equality on the day."""
    return buckets.select(
        "idx",
        F.explode(
            F.sequence("bucket_key", F.date_sub("next_key", 1), F.expr("INTERVAL 1 DAY"))
        ).alias("local_date"),
    )
