"""Everything the statistics page shows for one filter and range."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.functions.calendar import time_range
from medialog.functions.moments import instant
from medialog.operators import access_log, rollups, series
from medialog.operators.access_log import AccessFilter

PAGE_ROWS = 40


def stats_page(
    log: DataFrame,
    episodes: DataFrame,
    shows: DataFrame,
    range_key: str,
    now: datetime,
    zone: str,
    filters: AccessFilter = AccessFilter(),
    sort: str = "time",
    direction: str = "desc",
    offset: int = 0,
) -> dict[str, DataFrame]:
    """Named frames, evaluated only when used; each prunes the log to the range it needs."""
    scope = time_range(range_key, now, zone)
    upper = time_range(None, now, zone).to
    narrowed = AccessFilter(**{**vars(filters), "frm": scope.frm, "to": scope.to})
    if scope.frm is None:
        bounds = series.chart_bounds(log, upper)
    else:
        bounds = log.sparkSession.range(1).select(instant(scope.frm).alias("frm"), instant(scope.to).alias("to"))
    clients = rollups.by_client(log, scope.frm, scope.to)
    return {
        "overview": rollups.overview(log, scope.frm, scope.to, scope.prev_from),
        "shows": rollups.show_stats(shows, log, scope.frm, scope.to),
        "busiest": rollups.busiest(log, episodes, shows, 10, scope.frm, scope.to),
        "failures": access_log.recent_failures(log, episodes, shows, 6, scope.frm, scope.to),
        "daily": series.series_for_range(log, bounds, zone, scope.frm, scope.to),
        "clients": clients,
        "client_shares": series.share_bars(clients, "client", "n"),
        "entries": access_log.list_log(log, episodes, shows, narrowed, sort, direction, PAGE_ROWS, offset),
        "total": access_log.count_rows(log, narrowed),
    }
