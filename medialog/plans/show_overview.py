"""The wide mart of shows: counts, readiness, latest scan, access figures, health, address."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.functions import urls
from medialog.operators.catalogue import episode_counts
from medialog.operators.readiness import badge_warnings, show_health, with_readiness
from medialog.operators.rollups import SHOW_COUNTERS, show_figures, zero_fill
from medialog.operators.scan_log import latest_scan, parse_entries


def show_overview(
    shows: DataFrame, episodes: DataFrame, scans: DataFrame, log: DataFrame, base_url: str | None, now
) -> DataFrame:
    """One row per show. Every input is reduced to one row per show before it is joined."""
    base = urls.clean_base(base_url)
    rows = with_readiness(shows, episode_counts(episodes, now), base)
    last = latest_scan(scans.where(F.col("show_id").isNotNull())).select(
        "show_id",
        F.col("id").alias("scan_id"),
        F.col("finished_at").alias("scan_finished_at"),
        F.col("trigger").alias("scan_trigger"),
        F.col("added").alias("scan_added"),
        F.size(parse_entries(F.col("errors_json"))).alias("scan_errors"),
        F.size(parse_entries(F.col("warnings_json"))).alias("scan_warnings"),
    )
    rows = rows.join(last, "show_id", "left")
    rows = zero_fill(rows, show_figures(log), "show_id", SHOW_COUNTERS)
    address = urls.feed_url(F.lit(base), F.col("slug"), F.col("feed_token"))
    return rows.select(
        "show_id", "slug", "title", "status",
        "active", "missing", "removed", "expired", "scheduled", "in_feed", "in_feed_no_duration", "total",
        "ready", "blocking", "advisory",
        F.array_join(badge_warnings(), ",").alias("warnings"),
        show_health(F.col("scan_errors")).alias("health"),
        "scan_id", "scan_finished_at", "scan_trigger", "scan_added", "scan_errors", "scan_warnings",
        "downloads", "streams", "failures", "bytes", "episodes_touched", "last_at", "feed_fetches", "feed_last_at",
        "feed_last_client",
        address.alias("feed_url"),
    )
