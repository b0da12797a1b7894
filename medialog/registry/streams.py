"""Registered streaming jobs: each drains a file stream over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialog.operators import feeds
from medialog.registry.access import ENRICH_SQL, MEASURES
from medialog.registry.core import NOW, REGISTRY
from medialog.registry.publishing import BASE, BOTH, FEED_SQL, VERSION_SQL
from medialog.session import workspace
from medialog.sources.fixtures import streamed
from medialog.sources.store import read_log
from medialog.streaming import daily, feed_versions, ingest, signin_alerts


def _drain(query) -> None:
    query.awaitTermination()


def _ingest_deliveries(rows, path: str, checkpoint: str) -> None:
    """Rows into a log in three deliveries: by the last digit of their id, some of them twice.

    Each delivery spans all days, so the later ones are late by days. It has as many files as it was written by; the job
    takes it before the next is there.
    """
    digit = F.col("request_id") % 10
    for wanted in (digit < 6, digit.isin(4, 5, 6, 7), digit > 6):
        rows.where(wanted).write.mode("append").parquet(f"{path}/in")
        raw = ingest.raw_stream(rows.sparkSession, f"{path}/in", "parquet")
        _drain(ingest.ingest(raw, f"{path}/log", checkpoint))


# Ingestion keeps texts whole.
WHOLE_SQL = ENRICH_SQL.replace("LEFT(range_header, 80)", "range_header").replace(", 500) AS error", ", 1000000) AS error")


@REGISTRY.add("stream_ingest", WHOLE_SQL, ("raw_request",))
def _(t):
    path = workspace(t.spark, "ingest")
    _ingest_deliveries(t.raw_request, path, f"{path}/checkpoint")
    return read_log(t.spark, f"{path}/log").drop("requested_date", "batch")


@REGISTRY.add(
    "stream_daily_totals",
    f"""WITH en AS ({ENRICH_SQL}) SELECT CAST(requested_at - INTERVAL 5 HOUR AS DATE) AS local_date, show_id, {MEASURES}
FROM en WHERE kind IN ('download', 'stream') GROUP BY ALL""",
    ("raw_request",),
    ("local_date",),
)
def _(t):
    path = workspace(t.spark, "daily")
    _ingest_deliveries(t.raw_request, path, f"{path}/ingested")
    _drain(daily.follow(daily.log_stream(t.spark, f"{path}/log"), lambda: read_log(t.spark, f"{path}/log"), f"{path}/steps", f"{path}/checkpoint"))
    return daily.daily_by_show(daily.read_totals(t.spark, f"{path}/steps"), "America/New_York")


@REGISTRY.add(
    "stream_signin_alerts",
    """WITH w AS (SELECT username, UNNEST(generate_series(date_trunc('minute', attempted_at) + INTERVAL 1 MINUTE,
    date_trunc('minute', attempted_at) + INTERVAL 15 MINUTE, INTERVAL 1 MINUTE)) AS window_end
  FROM login_attempts WHERE succeeded = 0)
SELECT username, window_end, COUNT(*) AS failures FROM w
WHERE window_end <= (SELECT MAX(attempted_at) - INTERVAL 10 MINUTE FROM login_attempts) GROUP BY ALL HAVING COUNT(*) >= 2""",
    ("login_attempts",),
)
def _(t):
    path = workspace(t.spark, "alerts")
    _drain(signin_alerts.watch(streamed(t.spark, t.sf_dir, "login_attempts"), f"{path}/alerts", f"{path}/checkpoint"))
    return t.spark.read.schema("username STRING, window_end TIMESTAMP, failures BIGINT").parquet(f"{path}/alerts")


@REGISTRY.add(
    "stream_signin_attempts",
    """WITH w AS (SELECT a.username, a.id, a.attempted_at, a.succeeded,
    (SELECT COUNT(*) FROM login_attempts b WHERE b.username = a.username AND b.succeeded = 0
     AND b.attempted_at <= a.attempted_at AND b.attempted_at >= a.attempted_at - INTERVAL 15 MINUTE) AS trailing_failures,
    (SELECT COUNT(*) FROM login_attempts b WHERE b.username = a.username AND b.succeeded = 0
     AND (b.attempted_at, b.id) <= (a.attempted_at, a.id) AND b.attempted_at >= a.attempted_at - INTERVAL 15 MINUTE
     AND NOT EXISTS (SELECT 1 FROM login_attempts c WHERE c.username = a.username AND c.succeeded = 1
       AND (c.attempted_at, c.id) >= (b.attempted_at, b.id) AND (c.attempted_at, c.id) <= (a.attempted_at, a.id))) AS failures
  FROM login_attempts a)
SELECT * FROM w WHERE date_trunc('minute', attempted_at + INTERVAL 59999 MILLISECOND) <= (SELECT MAX(attempted_at) - INTERVAL 10 MINUTE FROM login_attempts)""",
    ("login_attempts",),
)
def _(t):
    path = workspace(t.spark, "attempts")
    _drain(signin_alerts.watch_attempts(streamed(t.spark, t.sf_dir, "login_attempts"), f"{path}/alerts", f"{path}/checkpoint", threshold=0))
    return t.spark.read.schema(signin_alerts.ALERT_SCHEMA).parquet(f"{path}/alerts")


@REGISTRY.add(
    "stream_feed_versions",
    f"{FEED_SQL}, {VERSION_SQL} SELECT vs.show_id, vs.version, lb.last_build_at AS modified_at FROM vs JOIN lb USING (show_id)",
    BOTH,
)
def _(t):
    path = workspace(t.spark, "versions")
    lines = feeds.feed_lines(t.episodes, t.shows, BASE, NOW)
    built = feeds.last_build(t.episodes, t.shows, BASE, NOW)
    observed = feeds.feed_versions(lines).select("show_id", "version").join(
        built.select("show_id", "last_build_at"), "show_id"
    )
    now = F.lit(NOW).cast("timestamp")
    # An hour ago every show had another version, built the day before that of now.
    earlier = observed.select("show_id", F.lit("old").alias("version"), (F.col("last_build_at") - F.expr("INTERVAL 1 DAY")).alias("last_build_at"))
    # A delivery has as many files as it was written by; the job takes it before the next is there.
    for rows, at in ((earlier, now - F.expr("INTERVAL 1 HOUR")), (observed, now)):
        rows.withColumn("observed_at", at).write.mode("append").parquet(f"{path}/observed")
        stream = t.spark.readStream.schema(feed_versions.OBSERVED).parquet(f"{path}/observed")
        _drain(feed_versions.follow_versions(stream, f"{path}/state", f"{path}/checkpoint"))
    return feed_versions.read_state(t.spark, f"{path}/state")
