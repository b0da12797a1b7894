"""Filtering, flagging, paging and trimming the access log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.functions.calendar import in_range
from medialog.operators.joins import lookup_join
from medialog.schemas import ACCESS_KINDS, MEDIA_KINDS

RETENTION_DAYS = 365
COMPLETE_SHARE = 0.98


def is_media() -> Column:
    return F.col("kind").isin(*MEDIA_KINDS)


def succeeded() -> Column:
    return F.col("status_code") < 400


@dataclass(frozen=True)
class AccessFilter:
    """Every way the log can be narrowed; rows and counts share it."""

    show_id: str | None = None
    episode_id: str | None = None
    failures_only: bool = False
    frm: datetime | None = None
    to: datetime | None = None
    kinds: Sequence[str] | None = None
    client: str | None = None

    def apply(self, log: DataFrame) -> DataFrame:
        if self.show_id:
            log = log.where(F.col("show_id") == self.show_id)
        if self.episode_id:
            log = log.where(F.col("episode_id") == self.episode_id)
        if self.failures_only:
            log = log.where(~succeeded())
        log = within(log, self.frm, self.to)
        # Unknown kinds are ignored; none or all of them is no filter.
        kinds = [k for k in ACCESS_KINDS if k in (self.kinds or ())]
        if 0 < len(kinds) < len(ACCESS_KINDS):
            log = log.where(F.col("kind").isin(*kinds))
        if self.client:
            log = log.where(F.col("client") == self.client)
        return log


def within(log: DataFrame, frm=None, to=None, column: str = "requested_at") -> DataFrame:
    """Keep ``[frm, to)``; with a day partition column, whole days are pruned first."""
    test = in_range(F.col(column), frm, to)
    if test is None:
        return log
    if "requested_date" in log.columns and column == "requested_at":
        if frm is not None:
            test = test & (F.col("requested_date") >= F.lit(frm.date()))
        if to is not None:
            test = test & (F.col("requested_date") <= F.lit(to.date()))
    return log.where(test)


def with_outcome_flags(log: DataFrame) -> DataFrame:
    """Add ok (below 400) and incomplete (a successful download well short of the file)."""
    incomplete = (
        (F.col("kind") == "download")
        & succeeded()
        & (F.col("total_bytes") > 0)
        & F.col("bytes_sent").isNotNull()
        & (F.col("bytes_sent") < F.col("total_bytes") * COMPLETE_SHARE)
    )
    return log.withColumns({"ok": succeeded(), "incomplete": F.coalesce(incomplete, F.lit(False))})


def enrich_log(log: DataFrame, episodes: DataFrame, shows: DataFrame) -> DataFrame:
    """Titles beside every log row; rows without an episode or show are kept."""
    titles = episodes.select(
        F.col("id").alias("episode_id"),
        F.col("title").alias("episode_title"),
        F.col("filename").alias("episode_filename"),
    )
    names = shows.select(
        F.col("id").alias("show_id"), F.col("title").alias("show_title"), F.col("slug").alias("show_slug")
    )
    out = lookup_join(log, titles, ["episode_id"], ["id"])
    return lookup_join(out, names, ["show_id"], ["id"])


# The sortable columns of the log.
SORTS = {
    "time": "requested_at",
    "bytes": "coalesce(bytes_sent, 0)",
    "status": "status_code",
    "kind": "kind",
    "client": "client",
}


def sort_order(sort: str, direction: str) -> tuple[Column, bool, list[Column]]:
    key = F.expr(SORTS.get(sort, SORTS["time"]))
    ascending = str(direction).lower() == "asc"
    # NULLs come first ascending and last descending. The id always breaks ties downwards.
    first = key.asc_nulls_first() if ascending else key.desc_nulls_last()
    return key, ascending, [first, F.col("id").desc()]


def page(
    log: DataFrame, sort: str = "time", direction: str = "desc", limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page by position, in a total order. For pages far down use :func:`page_after`, for a
    whole log the export."""
    _, _, order = sort_order(sort, direction)
    limit, offset = max(1, int(limit)), max(0, int(offset))
    out = log.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def page_after(
    log: DataFrame, last_value, last_id: int, sort: str = "time", direction: str = "desc", limit: int = 50
) -> DataFrame:
    """The page that follows a known last row: cost does not grow with depth."""
    key, ascending, order = sort_order(sort, direction)
    tie = F.col("id") < last_id
    if last_value is None:
        follows = key.isNull() & tie
        if ascending:
            follows = follows | key.isNotNull()
    else:
        value = F.lit(last_value)
        follows = (key > value if ascending else key < value) | ((key == value) & tie)
        if not ascending:
            follows = follows | key.isNull()
    return log.where(follows).orderBy(*order).limit(max(1, int(limit)))


def list_log(
    log: DataFrame,
    episodes: DataFrame,
    shows: DataFrame,
    filters: AccessFilter = AccessFilter(),
    sort: str = "time",
    direction: str = "desc",
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """Filter, cut the page out of the bare log, and only then look titles up."""
    rows = page(filters.apply(log), sort, direction, limit, offset)
    return with_outcome_flags(enrich_log(rows, episodes, shows))


def recent_failures(log, episodes, shows, limit: int = 10, frm=None, to=None, show_id=None) -> DataFrame:
    wanted = AccessFilter(failures_only=True, frm=frm, to=to, show_id=show_id)
    return list_log(log, episodes, shows, wanted, limit=limit)


def count_rows(log: DataFrame, filters: AccessFilter = AccessFilter()) -> DataFrame:
    return filters.apply(log).agg(F.count("*").alias("n"))


def access_extent(log: DataFrame) -> DataFrame:
    return log.agg(F.min("requested_at").alias("first_at"), F.max("requested_at").alias("last_at"))


def trim_access(log: DataFrame, now: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """What remains after rows older than ``days`` are dropped."""
    return within(log, frm=now - timedelta(days=days))


def export_columns() -> dict[str, Column]:
    """The twelve export columns of enriched, flagged rows, before quoting."""
    result = F.when(~F.col("ok"), "failed").when(F.col("incomplete"), "partial").otherwise("ok")
    return {
        "requested_at_utc": F.date_format("requested_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
        "show": F.col("show_title"),
        "episode": F.col("episode_title"),
        "filename": F.col("episode_filename"),
        "kind": F.col("kind"),
        "status_code": F.col("status_code"),
        "result": result,
        "bytes_sent": F.col("bytes_sent"),
        "total_bytes": F.col("total_bytes"),
        "range_header": F.col("range_header"),
        "app": F.col("client"),
        "error": F.col("error"),
    }
