"""The wide mart of episodes: resolved fields, addresses and access figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.functions import urls
from medialog.functions.moments import instant
from medialog.functions.text import is_blank
from medialog.operators.artwork import art_problems
from medialog.operators.catalogue import is_scheduled
from medialog.operators.joins import lookup_join
from medialog.operators.rollups import episode_totals, zero_fill


def episode_overview(episodes: DataFrame, shows: DataFrame, log: DataFrame, base_url: str | None, now) -> DataFrame:
    """One row per episode; an episode nobody fetched has explicit zeros.

    The log is reduced to one row per episode before it is joined.
    """
    base = F.lit(urls.clean_base(base_url))
    dims = shows.select(
        F.col("id").alias("show_id"), F.struct("slug", "feed_token", F.col("explicit").alias("explicit")).alias("show")
    )
    rows = lookup_join(episodes.withColumnRenamed("id", "episode_id"), dims, ["show_id"], ["episode_id"])
    rows = zero_fill(rows, episode_totals(log), "episode_id")
    show = F.col("show")
    has_art = ~is_blank(F.col("art_filename"))
    art = urls.art_url(base, show["slug"], show["feed_token"], F.col("episode_id"), F.col("art_etag"))
    sized = {"art_width", "art_height"} <= set(episodes.columns)
    problems = art_problems(F.col("art_width"), F.col("art_height")) if sized else F.lit(None).cast("array<string>")
    return rows.select(
        "episode_id",
        "show_id",
        show["slug"].alias("show_slug"),
        "filename",
        "title",
        (F.col("title_is_custom") == 1).alias("title_is_custom"),
        "season",
        "episode_number",
        F.coalesce("episode_type", F.lit("full")).alias("episode_type"),
        (F.coalesce("explicit", show["explicit"]) == 1).alias("resolved_explicit"),
        "pub_date",
        "duration_seconds",
        "file_size_bytes",
        "status",
        is_scheduled(instant(now)).alias("scheduled"),
        "missing_since",
        "removed_at",
        urls.media_url(base, show["slug"], show["feed_token"], F.col("episode_id"), F.col("filename")).alias("media_url"),
        F.when(has_art, art).alias("art_url"),
        F.when(has_art, F.array_join(problems, " and ")).alias("art_problems"),
        "downloads",
        "streams",
        "failures",
        "bytes",
        "last_at",
    )
