"""Event timeline derived from the current catalogue."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.operators.access_log import within
from medialog.operators.joins import lookup_join
from medialog.schemas import TIMELINE_EVENTS


def episode_events(episodes: DataFrame) -> DataFrame:
    """One to three events per row, from a single scan."""
    status = F.col("status")
    ended = F.col("removed_at").isNotNull() & status.isin("removed", "expired")

    def event(name, at):
        return F.struct(name.alias("event"), at.alias("event_at"))

    events = F.array_compact(
        F.array(
            event(F.lit("added"), F.col("created_at")),
            F.when(F.col("missing_since").isNotNull(), event(F.lit("missing"), F.col("missing_since"))),
            F.when(ended, event(F.when(status == "expired", "expired").otherwise("removed"), F.col("removed_at"))),
        )
    )
    return episodes.select(
        F.col("id").alias("episode_id"), "show_id", F.col("title").alias("episode_title"), "filename", "status",
        F.inline(events),
    )


def timeline_filter(events: DataFrame, show_id=None, kinds: Sequence[str] | None = None, frm=None, to=None) -> DataFrame:
    if show_id:
        events = events.where(F.col("show_id") == show_id)
    events = within(events, frm, to, "event_at")
    kinds = [k for k in TIMELINE_EVENTS if k in (kinds or ())]
    if 0 < len(kinds) < len(TIMELINE_EVENTS):
        events = events.where(F.col("event").isin(*kinds))
    return events


def episode_timeline(episodes: DataFrame, shows: DataFrame, **filters) -> DataFrame:
    """Filtered events with the show's title and slug."""
    names = shows.select(
        F.col("id").alias("show_id"), F.col("title").alias("show_title"), F.col("slug").alias("show_slug")
    )
    events = timeline_filter(episode_events(episodes), **filters)
    return lookup_join(events, names, ["show_id"], ["episode_id"], "inner")


def page_timeline(timeline: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    out = timeline.orderBy(F.desc("event_at"), F.desc("episode_id"), F.asc("event"))
    if offset > 0:
        out = out.offset(int(offset))
    return out.limit(max(1, int(limit)))


def count_timeline(episodes: DataFrame, shows: DataFrame, **filters) -> DataFrame:
    return episode_timeline(episodes, shows, **filters).agg(F.count("*").alias("n"))
