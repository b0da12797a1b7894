from __future__ import annotations

import itertools
from datetime import timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F

from medialog.operators import access_log, rollups
from medialog.operators.access_log import AccessFilter
from medialog.schemas import MEDIA_ACCESS

BASE = at("2024-03-01T00:00:00")


def log_of(spark, rows):
    """Rows of (id, minutes after BASE, kind, status, bytes, total, client, episode, show)."""
    full = [
        (i, ep, show, BASE + timedelta(minutes=m), kind, status, sent, total, None, client, None)
        for i, m, kind, status, sent, total, client, ep, show in rows
    ]
    return spark.createDataFrame(full, MEDIA_ACCESS)


@pytest.fixture(scope="module")
def tied(spark):
    """Many equal times, sizes, kinds and clients."""
    kinds = ("download", "stream", "cover", "feed")
    rows = [
        (i, i // 10, kinds[i % 4], (200, 206, 304, 404, 500)[i % 5], None if i % 7 == 0 else (i % 6) * 100, 500,
         (None, "Overcast", "Castro")[i % 3], f"e{i % 9}" if i % 4 < 2 else None, f"s{i % 3}")
        for i in range(120)
    ]
    return log_of(spark, rows).cache()


def test_half_open(spark):
    log = log_of(spark, [(1, 0, "download", 200, 1, 1, None, "e", "s"), (2, 60, "download", 200, 1, 1, None, "e", "s")])
    hour = AccessFilter(frm=BASE, to=BASE + timedelta(hours=1))
    after = AccessFilter(frm=BASE + timedelta(hours=1), to=BASE + timedelta(hours=2))
    assert [r.id for r in hour.apply(log).collect()] == [1]
    assert [r.id for r in after.apply(log).collect()] == [2]


def test_rows_and_count_agree(tied):
    options = itertools.product(
        (None, "s1"), (False, True), (None, ["download"], ["nonsense"], list(access_log.ACCESS_KINDS)), (None, "Castro")
    )
    for show, failures, kinds, client in options:
        wanted = AccessFilter(show_id=show, failures_only=failures, kinds=kinds, client=client)
        assert access_log.count_rows(tied, wanted).first().n == wanted.apply(tied).count()
    assert AccessFilter(kinds=["nonsense"]).apply(tied).count() == 120


def expected_order(rows, sort, direction):
    key = {
        "time": lambda r: r.requested_at, "bytes": lambda r: r.bytes_sent or 0, "status": lambda r: r.status_code,
        "kind": lambda r: r.kind, "client": lambda r: (r.client is not None, r.client or ""),
    }[sort]
    by_id = sorted(rows, key=lambda r: -r.id)
    return [r.id for r in sorted(by_id, key=key, reverse=direction == "desc")]


@pytest.mark.parametrize("sort", list(access_log.SORTS))
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_paging_shows_each_row_once(tied, sort, direction):
    want = expected_order(tied.collect(), sort, direction)
    by_offset = [r.id for o in range(0, 120, 50) for r in access_log.page(tied, sort, direction, 50, o).collect()]
    assert by_offset == want
    by_key, last = [], None
    while True:
        rows = (access_log.page(tied, sort, direction, 50) if last is None else access_log.page_after(
            tied, last.key, last.id, sort, direction, 50)).withColumn("key", F.expr(access_log.SORTS[sort])).collect()
        if not rows:
            break
        by_key += [r.id for r in rows]
        last = rows[-1]
    assert by_key == want


def test_a_page_may_be_as_long_as_asked(spark):
    log = spark.range(60_000).select("id", F.lit(BASE).cast("timestamp").alias("requested_at"))
    assert access_log.page(log, limit=55_000).count() == 55_000
    assert access_log.page_after(log, BASE, 59_999, limit=55_000).count() == 55_000


def test_a_page_has_a_row_at_least(tied):
    assert access_log.page(tied, limit=0).count() == 1
    assert access_log.page(tied, limit=-5, offset=-3).count() == 1
    assert access_log.page(tied, sort="nonsense", direction="sideways", limit=3).collect() == access_log.page(tied, limit=3).collect()


def test_incomplete_flag(spark):
    cases = [
        (1, 0, "download", 200, 979, 1000, None, "e", "s"), (2, 0, "download", 200, 980, 1000, None, "e", "s"),
        (3, 0, "stream", 206, 1, 1000, None, "e", "s"), (4, 0, "download", 404, 1, 1000, None, "e", "s"),
        (5, 0, "download", 200, None, 1000, None, "e", "s"), (6, 0, "download", 200, 1, None, None, "e", "s"),
    ]
    rows = access_log.with_outcome_flags(log_of(spark, cases)).orderBy("id").collect()
    assert [r.incomplete for r in rows] == [True, False, False, False, False, False]
    assert [r.ok for r in rows] == [True, True, True, False, True, True]


def test_retention_boundary(spark):
    log = log_of(spark, [(1, 0, "feed", 200, 1, 1, None, None, "s"), (2, 1, "feed", 200, 1, 1, None, None, "s")])
    kept = access_log.trim_access(log, BASE + timedelta(days=10, minutes=1), days=10)
    assert [r.id for r in kept.collect()] == [2]


def test_grouped_equals_single(tied):
    grouped = {r.episode_id: r for r in rollups.episode_totals(tied).collect()}
    for episode in ("e0", "e4"):
        single = rollups.episode_totals(tied.where(F.col("episode_id") == episode)).first()
        assert grouped[episode] == single


def test_failures_of_rollups_leave_feeds_out(spark):
    log = log_of(spark, [
        (1, 0, "feed", 500, None, None, None, None, "s"), (2, 1, "download", 500, 7, 9, None, "e", "s"),
        (3, 2, "feed", 304, 0, None, "Castro", None, "s"),
    ])
    row = rollups.show_rollup(log).first()
    assert (row.failures, row.bytes, row.feed_fetches, row.episodes_touched) == (1, 7, 1, 1)
    assert AccessFilter(failures_only=True).apply(log).count() == 2


def test_overview_split_at_the_boundary(spark):
    log = log_of(spark, [(i, m, "download", 200, 10, 10, None, "e", "s") for i, m in enumerate([0, 59, 60, 61, 119, 120])])
    h = timedelta(hours=1)
    row = rollups.overview(log, BASE + h, BASE + 2 * h, BASE).first()
    assert (row.downloads, row.prev_downloads) == (3, 2)
    assert row.downloads_change.direction == "up" and row.downloads_change.percent == 50.0
    assert row.streams_change.percent is None and row.streams_change.direction == "flat"
    assert row.last_ever_at == BASE + 2 * h
    everything = rollups.overview(log, BASE + h, BASE + 2 * h, None).first()
    assert everything.downloads == 6, "without a previous period the bounds are ignored"


def test_empty_log(spark):
    log = spark.createDataFrame([], MEDIA_ACCESS)
    row = rollups.overview(log).first()
    assert (row.downloads, row.streams, row.failures, row.bytes, row.last_at) == (0, 0, 0, 0, None)


def test_last_feed_fetch_breaks_ties_by_id(spark):
    log = log_of(spark, [
        (1, 5, "feed", 200, 1, 1, "Castro", None, "s"), (9, 5, "feed", 304, 0, 1, None, None, "s"),
        (7, 5, "feed", 200, 1, 1, "Overcast", None, "s"), (10, 6, "feed", 404, 1, 1, "VLC", None, "s"),
    ])
    row = rollups.last_feed_fetch(log).first()
    assert (row.feed_last_client, row.feed_last_at) == (None, BASE + timedelta(minutes=5))


def test_busiest_gives_as_many_as_asked(spark):
    log = log_of(spark, [(i, i, "download", 200, 1, 9, None, f"e{i}", "s") for i in range(130)])
    episodes = spark.createDataFrame([(f"e{i}", "t") for i in range(130)], "id string, title string")
    shows = spark.createDataFrame([("s", "S", "s")], "id string, title string, slug string")
    assert rollups.busiest(log, episodes, shows, 120).count() == 120
