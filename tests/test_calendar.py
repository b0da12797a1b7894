from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from conftest import at
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from medialog.functions.calendar import bucket_days, calendar_buckets, range_columns, time_range
from medialog.functions.moments import instant, local_date
from medialog.operators.series import daily_series

ZONES = ("UTC", "Europe/London", "Pacific/Auckland", "America/New_York", "Asia/Kolkata", "America/Santiago", "Africa/Cairo")


def buckets(spark, frm, to, zone, size=92):
    bounds = spark.range(1).select(instant(at(frm)).alias("frm"), instant(at(to)).alias("to"))
    return calendar_buckets(bounds, zone, size).orderBy("idx").collect()


def test_ranges():
    r = time_range("7d", at("2026-08-12T10:00:00"), "Europe/London")
    assert (r.frm, r.to, r.prev_from) == (at("2026-08-05T23:00:00"), at("2026-08-12T23:00:00"), at("2026-07-29T23:00:00"))
    assert time_range("bogus", at("2026-08-12T10:00:00"), "UTC").key == "30d"
    assert time_range(None, at("2026-08-12T10:00:00"), "UTC").days == 30
    assert time_range("all", at("2026-08-12T10:00:00"), "UTC").frm is None


def test_range_over_a_clock_change_counts_calendar_days():
    r = time_range("7d", at("2026-04-01T12:00:00"), "Europe/London")
    assert r.to - r.frm == timedelta(days=7) - timedelta(hours=1)


def test_change_day_in_auckland_starts_at_local_midnight():
    r = time_range("7d", at("2026-09-27T20:00:00"), "Pacific/Auckland")
    assert r.to == at("2026-09-28T11:00:00")
    assert r.frm == at("2026-09-21T12:00:00")


@settings(max_examples=15, deadline=None)
@given(st.datetimes(datetime(2023, 1, 1), datetime(2027, 1, 1)), st.sampled_from(ZONES), st.sampled_from(["7d", "30d", "90d"]))
def test_column_form_agrees_with_plain_form(spark, now, zone, key):
    now = now.replace(microsecond=0)
    plain = time_range(key, now, zone)
    cols = range_columns(key, instant(now), zone)
    row = spark.range(1).select(*[c.cast("string").alias(n) for n, c in cols.items()]).first()
    assert [datetime.fromisoformat(v) for v in row] == [plain.frm, plain.to, plain.prev_from]


def test_days_of_23_and_25_hours(spark):
    spring = buckets(spark, "2026-03-28T00:00:00", "2026-03-30T23:00:00", "Europe/London")
    assert [(b.end_at - b.start_at).total_seconds() / 3600 for b in spring] == [24, 23, 24]
    autumn = buckets(spark, "2026-10-23T23:00:00", "2026-10-27T00:00:00", "Europe/London")
    assert [(b.end_at - b.start_at).total_seconds() / 3600 for b in autumn] == [24, 25, 24]


@pytest.mark.parametrize(
    "days, width, count", [(1, 1, 1), (92, 1, 92), (93, 7, 14), (92 * 7, 7, 92)],
)
def test_widths(spark, days, width, count):
    to = at("2024-01-01T00:00:00") + timedelta(days=days)
    got = buckets(spark, "2024-01-01T00:00:00", to.isoformat(), "UTC")
    assert len(got) == count and got[-1].end_at == to
    assert all((b.end_at - b.start_at).days == width for b in got[:-1])


def test_months_after_that(spark):
    got = buckets(spark, "2024-08-15T00:00:00", "2026-08-20T00:00:00", "UTC", 92)
    assert len(got) == 25 or got[0].label == "Aug 2024"
    assert got[0].label == "Aug 2024" and got[1].label == "Sept 2024"
    assert str(got[1].bucket_key) == "2024-09-01" and got[-1].end_at == at("2026-08-20T00:00:00")


def test_no_bounds_no_buckets(spark):
    bounds = spark.range(1).select(F.lit(None).cast("timestamp").alias("frm"), instant(at("2024-01-01T00:00:00")).alias("to"))
    assert calendar_buckets(bounds, "UTC").count() == 0
    assert buckets(spark, "2024-01-02T00:00:00", "2024-01-01T00:00:00", "UTC") == []


@settings(max_examples=12, deadline=None)
@given(st.datetimes(datetime(2023, 1, 1), datetime(2026, 1, 1)), st.integers(1, 1200), st.sampled_from(ZONES))
def test_buckets_tile_the_range(spark, start, days, zone):
    got = buckets(spark, start.isoformat(), (start + timedelta(days=days)).isoformat(), zone)
    assert all(a.end_at == b.start_at for a, b in zip(got, got[1:]))
    assert [b.idx for b in got] == list(range(len(got)))
    bounds = spark.createDataFrame([(b.idx, b.bucket_key, b.next_key) for b in got], "idx INT, bucket_key DATE, next_key DATE")
    covered = bucket_days(bounds)
    assert covered.count() == covered.select("local_date").distinct().count() == (got[-1].next_key - got[0].bucket_key).days


def test_series_equals_the_range_join_it_replaces(spark):
    """Brute force over the days of a clock change."""
    start = at("2026-03-27T00:00:00")
    rows = [
        (i, "e1", "s1", start + timedelta(minutes=37 * i), ("download", "stream", "feed")[i % 3], (200, 206, 404)[i % 3 if i % 5 else 2], i)
        for i in range(200)
    ]
    log = spark.createDataFrame(rows, "id BIGINT, episode_id STRING, show_id STRING, requested_at TIMESTAMP, kind STRING, status_code INT, bytes_sent BIGINT")
    bounds = spark.range(1).select(instant(at("2026-03-28T00:00:00")).alias("frm"), instant(at("2026-04-02T23:00:00")).alias("to"))
    b = calendar_buckets(bounds, "Europe/London")
    got = daily_series(log, b, "Europe/London").orderBy("idx").collect()
    for bucket in got:
        inside = [r for r in rows if bucket.start_at <= r[3] < bucket.end_at and r[4] in ("download", "stream")]
        assert bucket.downloads == sum(r[4] == "download" and r[5] < 400 for r in inside)
        assert bucket.streams == sum(r[4] == "stream" and r[5] < 400 for r in inside)
        assert bucket.failures == sum(r[5] >= 400 for r in inside)
        assert bucket.bytes == sum(r[6] for r in inside)
    assert got[-1].downloads == 0, "a quiet day is drawn as zero"


def test_local_date(spark):
    row = spark.range(1).select(local_date(instant(at("2026-07-01T23:30:00")), "Europe/London").cast("string")).first()
    assert row[0] == "2026-07-02"
