"""Episode and show life cycle: expiry, removal, restoring, rebuilding, deletion."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.functions.moments import instant
from medialog.operators.catalogue import episode_counts
from medialog.operators.joins import lookup_join
from medialog.operators.reconcile import Reconciled, reconcile

MIN_GRACE = 60
MAX_GRACE = 30 * 24 * 3600


def sweep_missing(episodes: DataFrame, now, grace_seconds: int) -> DataFrame:
    """Missing since the cutoff or before becomes expired; missing_since stays."""
    grace = min(MAX_GRACE, max(MIN_GRACE, grace_seconds))
    stale = (F.col("status") == "missing") & (F.col("missing_since") <= instant(now - timedelta(seconds=grace)))
    stale = F.coalesce(stale, F.lit(False))
    return episodes.withColumns(
        {
            "removed_at": F.when(stale, instant(now)).otherwise(F.col("removed_at")),
            "updated_at": F.when(stale, instant(now)).otherwise(F.col("updated_at")),
            "status": F.when(stale, "expired").otherwise(F.col("status")),
        }
    )


def apply_decisions(episodes: DataFrame, decisions: DataFrame, now) -> DataFrame:
    """Apply remove and restore decisions (id, decision, decided_at); the last one counts."""
    last = decisions.groupBy("id").agg(
        F.max_by("decision", F.struct("decided_at", "decision")).alias("decision")
    )
    removed, restored = F.col("decision") == "remove", F.col("decision") == "restore"
    decided = removed | restored
    out = episodes.join(last, "id", "left")
    return out.withColumns(
        {
            "status": F.when(removed, "removed").when(restored, "active").otherwise(F.col("status")),
            "removed_at": F.when(removed, instant(now)).when(restored, None).otherwise(F.col("removed_at")),
            "missing_since": F.when(decided, None).otherwise(F.col("missing_since")),
            "updated_at": F.when(decided, instant(now)).otherwise(F.col("updated_at")),
        }
    ).select(*episodes.columns)


def rebuild(
    listing: DataFrame, episodes: DataFrame, shows: DataFrame, chosen: DataFrame, now, id_salt: str
) -> tuple[Reconciled, DataFrame]:
    """Forget every row of the chosen shows and import their files anew, with new ids.

    Shows whose folder is missing are refused. Returns the pass and, per show, the counts
    before and after.
    """
    allowed = (
        shows.where(F.col("status") != "folder_missing")
        .select(F.col("id").alias("show_id"))
        .join(chosen.select("show_id").distinct(), "show_id", "left_semi")
    )
    files = lookup_join(listing, allowed, ["show_id"], ["filename"], "left_semi")
    forgotten = lookup_join(episodes, allowed, ["show_id"], ["id"], "left_semi")
    done = reconcile(files, episodes.limit(0), now, id_salt, rehash=True)
    before = episode_counts(forgotten, now).select(
        "show_id", F.col("total").alias("forgotten"), F.col("in_feed").alias("in_feed_before")
    )
    after = episode_counts(done.episodes, now).select(
        "show_id", F.col("total").alias("imported"), F.col("in_feed").alias("in_feed_after")
    )
    counts = (
        allowed.join(before, "show_id", "left")
        .join(after, "show_id", "left")
        .na.fill(0, ["forgotten", "in_feed_before", "imported", "in_feed_after"])
    )
    return done, counts


def remove_shows(tables: dict[str, DataFrame], ids: DataFrame, now, files_too: bool = False) -> dict[str, DataFrame]:
    """Delete shows and all their rows; folders that stay are remembered as removed on purpose.

    ``tables`` holds shows, episodes, scan_log, media_access and removed_folders; ``ids`` has
    the column show_id.
    """
    ids = ids.select("show_id").distinct()
    out = {"shows": tables["shows"].join(ids.select(F.col("show_id").alias("id")), "id", "left_anti")}
    for name in ("episodes", "scan_log", "media_access"):
        if name in tables:
            out[name] = lookup_join(tables[name], ids, ["show_id"], ["id"], "left_anti")
    tombstones = tables["removed_folders"]
    if not files_too:
        fresh = (
            tables["shows"]
            .join(ids.select(F.col("show_id").alias("id")), "id", "left_semi")
            .select("slug", instant(now).alias("removed_at"))
        )
        tombstones = tombstones.join(fresh, "slug", "left_anti").unionByName(fresh)
    out["removed_folders"] = tombstones
    return out
