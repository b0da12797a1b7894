"""The stored catalogue: live rows, feed eligibility, counts, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.functions.moments import instant
from medialog.functions.text import nocase_key
from medialog.schemas import LIVE_STATUSES


def is_live() -> Column:
    return F.col("status").isin(*LIVE_STATUSES)


def feed_eligible(now) -> Column:
    """In the feed: live and already published."""
    return is_live() & (F.col("pub_date") <= instant(now))


def is_scheduled(now) -> Column:
    """Live, with a publish date still to come. Derived, never stored."""
    return is_live() & (F.col("pub_date") > instant(now))


def status_rank() -> Column:
    return (
        F.when(F.col("status") == "active", 0)
        .when(F.col("status") == "missing", 1)
        .when(F.col("status") == "expired", 2)
        .otherwise(3)
    )


def live_row_per_filename(episodes: DataFrame) -> DataFrame:
    """The row that stands for a file name: liveliest status, then latest update, then id.

    An aggregate rather than a window: it combines before the shuffle, however many rows
    share a name.
    """
    newest = -F.coalesce(F.unix_micros("updated_at"), F.lit(0))
    best = F.min_by(F.struct(*episodes.columns), F.struct(status_rank(), newest, F.col("id")))
    return episodes.groupBy("show_id", "filename").agg(best.alias("row")).select("row.*")


def episode_counts(episodes: DataFrame, now) -> DataFrame:
    """Per show: rows by status, scheduled, in the feed, in the feed without a duration."""
    eligible = feed_eligible(now)
    return episodes.groupBy("show_id").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("active", "missing", "removed", "expired")],
        F.count_if(is_scheduled(now)).alias("scheduled"),
        F.count_if(eligible).alias("in_feed"),
        F.count_if(eligible & F.col("duration_seconds").isNull()).alias("in_feed_no_duration"),
        F.count("*").alias("total"),
    )


COUNT_COLUMNS = ("active", "missing", "removed", "expired", "scheduled", "in_feed", "in_feed_no_duration", "total")


def list_shows(shows: DataFrame) -> DataFrame:
    """By title, ASCII letters case-insensitive, then id."""
    return shows.orderBy(nocase_key(F.col("title")), "id")


def unseen(episodes: DataFrame, seen: DataFrame) -> DataFrame:
    """Active or missing rows that no listed file stands for."""
    return episodes.where(is_live()).join(seen, ["show_id", "identity_key"], "left_anti")
