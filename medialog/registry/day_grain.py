"""Registered queries over the log reduced to days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from medialog.functions.calendar import calendar_buckets
from medialog.functions.moments import local_date
from medialog.operators import rollups
from medialog.plans.day_grain import DayGrain
from medialog.registry.access import LOG, MEASURES, MEDIA, NY_FROM, NY_TO, PERIOD, ROLLUP, SERIES_SQL, TOTALS, ZONE, _compare_columns
from medialog.registry.core import REGISTRY
from medialog.session import workspace

NY_PERIOD = "requested_at >= TIMESTAMP '2024-01-10 05:00:00' AND requested_at < TIMESTAMP '2024-01-25 05:00:00'"
FIRST, LAST = date(2024, 1, 10), date(2024, 1, 25)


def _grain(t) -> DayGrain:
    """Built without some rows of two days, which then come late."""
    day = local_date(F.col("requested_at"), ZONE)
    late = day.isin(date(2024, 1, 12), date(2024, 1, 20)) & (F.col("id") % 2 == 0)
    grain = DayGrain(t.spark, workspace(t.spark, "day-grain"), ZONE)
    grain.refresh(t.media_access.where(~late))
    grain.refresh(t.media_access, t.media_access.where(late).select(day.alias("day")))
    return grain


@REGISTRY.add("grain_show_rollup", ROLLUP.replace(PERIOD, NY_PERIOD), LOG)
def _(t):
    return _grain(t).show_rollup(FIRST, LAST)


@REGISTRY.add("grain_episode_totals", TOTALS.replace(PERIOD, NY_PERIOD) + " GROUP BY episode_id", LOG)
def _(t):
    return _grain(t).episode_totals(FIRST, LAST)


@REGISTRY.add("grain_daily_series", SERIES_SQL + " SELECT * FROM series", LOG, ("bucket_key",))
def _(t):
    bounds = t.spark.range(1).select(F.lit(NY_FROM).alias("frm"), F.lit(NY_TO).alias("to"))
    return _grain(t).daily_series(calendar_buckets(bounds, ZONE), FIRST, LAST)


@REGISTRY.add(
    "grain_overview_all",
    f"SELECT {MEASURES}, MAX(requested_at) FILTER (WHERE {MEDIA}) AS last_at, MAX(requested_at) AS last_ever_at FROM media_access",
    LOG,
)
def _(t):
    return _grain(t).overview()


@REGISTRY.add(
    "grain_overview_compare",
    f"""WITH cur AS (SELECT {MEASURES}, MAX(requested_at) FILTER (WHERE {MEDIA}) AS last_at FROM media_access
  WHERE requested_at >= TIMESTAMP '2024-01-20 05:00:00' AND requested_at < TIMESTAMP '2024-01-28 05:00:00'),
prv AS (SELECT downloads AS prev_downloads, streams AS prev_streams, failures AS prev_failures, bytes AS prev_bytes FROM (
  SELECT {MEASURES} FROM media_access WHERE requested_at >= TIMESTAMP '2024-01-12 05:00:00' AND requested_at < TIMESTAMP '2024-01-20 05:00:00'))
SELECT {", ".join(_compare_columns(c) for c in rollups.COUNTERS)}, last_at,
  (SELECT MAX(requested_at) FROM media_access) AS last_ever_at FROM cur, prv""",
    LOG,
)
def _(t):
    out = _grain(t).overview(date(2024, 1, 20), date(2024, 1, 28), date(2024, 1, 12))
    flat = []
    for c in rollups.COUNTERS:
        change = F.col(f"{c}_change")
        flat += [
            F.col(c), F.col(f"prev_{c}"), change["absolute"].alias(f"{c}_absolute"),
            F.round(change["percent"], 6).alias(f"{c}_percent"), change["direction"].alias(f"{c}_direction"),
        ]
    return out.select(*flat, "last_at", "last_ever_at")
