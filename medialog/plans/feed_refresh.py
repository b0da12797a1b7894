"""Refreshing the feeds of changed shows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.operators import feeds
from medialog.operators.joins import lookup_join
from medialog.session import workspace
from medialog.sources.export import write_feeds


def refresh_feeds(
    episodes: DataFrame,
    shows: DataFrame,
    state: DataFrame,
    base_url: str,
    now: datetime,
    path: str,
    only: DataFrame | None = None,
    announce_move: bool = False,
) -> DataFrame:
    """Write the documents that changed and return the new version state.

    ``only`` (show_id) limits the work to shows named by a change set.
    """
    if only is not None:
        ids = only.select("show_id").distinct()
        shows = shows.join(ids.select(F.col("show_id").alias("id")), "id", "left_semi")
        episodes = lookup_join(episodes, ids, ["show_id"], ["id"], "left_semi")
    spark = episodes.sparkSession
    # Lines are read twice, for the version and for the output: render them once.
    rendered = workspace(spark, "feed-lines")
    feeds.feed_lines(episodes, shows, base_url, now, announce_move).write.parquet(rendered)
    lines = spark.read.parquet(rendered)
    built = feeds.last_build(episodes, shows, base_url, now)
    current = feeds.feed_versions(lines).select("show_id", "version").join(
        built.select("show_id", "last_build_at"), "show_id"
    )
    advanced = feeds.advance_versions(current, state, now)
    moved = advanced.where("changed").select("show_id")
    write_feeds(lookup_join(lines, moved, ["show_id"], ["line"], "left_semi"), path)
    rest = state.join(advanced.select("show_id"), "show_id", "left_anti")
    return advanced.select("show_id", "version", "modified_at").unionByName(rest.select("show_id", "version", "modified_at"))
