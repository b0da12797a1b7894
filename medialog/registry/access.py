"""Registered queries over the access log."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from medialog.functions.calendar import calendar_buckets, range_columns
from medialog.functions.moments import local_date, local_midnight
from medialog.functions.text import csv_cell
from medialog.operators import access_log, rollups, series
from medialog.operators.access_log import AccessFilter
from medialog.plans import buckets, stored_log
from medialog.registry.core import FRM, NOW, REGISTRY, TO
from medialog.session import workspace
from medialog.sources import requests
from medialog.sources.store import append_log, read_log

LOG = ("media_access",)
ALL = ("shows", "episodes", "media_access")
ZONE = "America/New_York"  # five hours behind UTC over the whole log

MEASURES = """
  CAST(COUNT(*) FILTER (WHERE kind = 'download' AND status_code < 400) AS BIGINT) AS downloads,
  CAST(COUNT(*) FILTER (WHERE kind = 'stream' AND status_code < 400) AS BIGINT) AS streams,
  CAST(COUNT(*) FILTER (WHERE kind IN ('download','stream') AND status_code >= 400) AS BIGINT) AS failures,
  CAST(COALESCE(SUM(bytes_sent) FILTER (WHERE kind IN ('download','stream')), 0) AS BIGINT) AS bytes"""
PERIOD = "requested_at >= TIMESTAMP '2024-01-10' AND requested_at < TIMESTAMP '2024-01-25'"
MEDIA = "kind IN ('download', 'stream')"
FLAGS = """status_code < 400 AS ok,
  COALESCE(kind = 'download' AND status_code < 400 AND total_bytes > 0 AND bytes_sent IS NOT NULL
           AND bytes_sent < total_bytes * 0.98, FALSE) AS incomplete"""
ROLLUP = f"""SELECT show_id, {MEASURES},
  COUNT(DISTINCT episode_id) FILTER (WHERE {MEDIA}) AS episodes_touched,
  MAX(requested_at) FILTER (WHERE {MEDIA}) AS last_at,
  COUNT(*) FILTER (WHERE kind = 'feed' AND status_code < 400) AS feed_fetches,
  MAX(requested_at) FILTER (WHERE kind = 'feed' AND status_code < 400) AS feed_last_at
FROM media_access WHERE {PERIOD} AND ({MEDIA} OR (kind = 'feed' AND status_code < 400)) GROUP BY show_id"""
ENRICHED = f"""SELECT a.*, e.title AS episode_title, e.filename AS episode_filename,
  s.title AS show_title, s.slug AS show_slug, {FLAGS}
FROM media_access a LEFT JOIN episodes e ON e.id = a.episode_id LEFT JOIN shows s ON s.id = a.show_id"""
NY_DAY = "CAST(requested_at - INTERVAL 5 HOUR AS DATE)"


# --- ingestion

CLIENT_SQL = """CASE WHEN user_agent IS NULL OR user_agent = '' THEN 'Unknown'
  WHEN regexp_matches(lower(user_agent), 'pocketcasts|pocket casts') THEN 'Pocket Casts'
  WHEN lower(user_agent) LIKE '%overcast%' THEN 'Overcast'
  WHEN lower(user_agent) LIKE '%castro%' THEN 'Castro'
  WHEN lower(user_agent) LIKE '%antennapod%' THEN 'AntennaPod'
  WHEN lower(user_agent) LIKE '%podcastaddict%' THEN 'Podcast Addict'
  WHEN lower(user_agent) LIKE '%downcast%' THEN 'Downcast'
  WHEN lower(user_agent) LIKE '%breaker%' THEN 'Breaker'
  WHEN lower(user_agent) LIKE '%spotify%' THEN 'Spotify'
  WHEN regexp_matches(lower(user_agent), 'itunes|apple ?podcasts|itms|applecoremedia|podcasts/') THEN 'Apple Podcasts'
  WHEN regexp_matches(lower(user_agent), 'watchos|ios|iphone|ipad') THEN 'iOS'
  WHEN lower(user_agent) LIKE '%android%' THEN 'Android'
  WHEN lower(user_agent) LIKE '%vlc%' THEN 'VLC'
  WHEN regexp_matches(lower(user_agent), 'curl|wget|httpie') THEN 'Command line'
  WHEN regexp_matches(lower(user_agent), 'mozilla|chrome|safari|firefox|edge') THEN 'Browser'
  ELSE 'Other' END"""
SUBJECT_SQL = "CASE WHEN file_name IS NULL THEN 'this file' ELSE '`' || file_name || '`' END"
BYTES_SQL = """CAST(CASE WHEN aborted THEN NULL WHEN status_code = 304 THEN 0
  WHEN stated_bytes IS NOT NULL THEN stated_bytes ELSE NULLIF(content_length, 0) END AS BIGINT)"""
ERROR_SQL = f"""CASE WHEN aborted THEN '{requests.ABORTED}' WHEN error IS NOT NULL THEN error
  WHEN status_code >= 500 THEN 'Sending ' || {SUBJECT_SQL} || ' failed part-way: it could no longer be read.'
  WHEN status_code = 416 THEN 'A part of ' || {SUBJECT_SQL} || ' was requested that does not exist; the client may hold an older copy.'
  WHEN status_code >= 400 THEN {SUBJECT_SQL} || ' could not be served (HTTP ' || status_code || ').' END"""
ENRICH_SQL = f"""
SELECT request_id AS id, episode_id, show_id, requested_at,
  CASE WHEN route <> 'media' THEN route WHEN range_header IS NULL THEN 'download' ELSE 'stream' END AS kind,
  status_code, {BYTES_SQL} AS bytes_sent, total_bytes, LEFT(range_header, 80) AS range_header,
  {CLIENT_SQL} AS client, LEFT({ERROR_SQL}, 500) AS error
FROM raw_request WHERE NOT is_owner"""


@REGISTRY.add("enrich_requests", ENRICH_SQL, ("raw_request",))
def _(t):
    return requests.enrich_requests(t.raw_request, range_chars=80, error_chars=500)


@REGISTRY.add(
    "request_outcome",
    f"SELECT request_id, status_code, aborted, {BYTES_SQL} AS bytes_sent, {ERROR_SQL} AS error FROM raw_request",
    ("raw_request",),
)
def _(t):
    return requests.derive_outcome(t.raw_request).select("request_id", "status_code", "aborted", "bytes_sent", "error")


@REGISTRY.add(
    "redact_urls",
    r"""SELECT request_id, CASE
  WHEN regexp_matches(url, '^/feeds/[^/]+/[^/]+\.xml') THEN regexp_replace(url, '^(/feeds/[^/]+/)[^/]+(\.xml)', '\1***\2')
  ELSE regexp_replace(url, '^(/media/[^/]+/)[^/]+', '\1***') END AS url FROM raw_request""",
    ("raw_request",),
)
def _(t):
    return requests.redacted(t.raw_request.select("request_id", "url"))


# --- the log itself

FILTER = AccessFilter(frm=FRM, to=TO, kinds=["download", "feed", "bogus"], client="Overcast")


@REGISTRY.add(
    "access_filtered",
    f"SELECT * FROM media_access WHERE {PERIOD} AND kind IN ('download', 'feed') AND client = 'Overcast'",
    LOG,
)
def _(t):
    return FILTER.apply(t.media_access)


@REGISTRY.add(
    "log_count",
    f"SELECT COUNT(*) AS n FROM media_access WHERE {PERIOD} AND kind IN ('download', 'feed') AND client = 'Overcast'",
    LOG,
)
def _(t):
    return access_log.count_rows(t.media_access, FILTER)


@REGISTRY.add(
    "incomplete_downloads",
    f"SELECT id, episode_id, bytes_sent, total_bytes FROM (SELECT *, {FLAGS} FROM media_access) WHERE incomplete",
    LOG,
)
def _(t):
    rows = access_log.with_outcome_flags(t.media_access).where("incomplete")
    return rows.select("id", "episode_id", "bytes_sent", "total_bytes")


@REGISTRY.add("access_log_enriched", ENRICHED, ALL)
def _(t):
    return access_log.with_outcome_flags(access_log.enrich_log(t.media_access, t.episodes, t.shows))


@REGISTRY.add(
    "log_page",
    ENRICHED + " ORDER BY COALESCE(a.bytes_sent, 0) ASC, a.id DESC LIMIT 40 OFFSET 80",
    ALL,
)
def _(t):
    return access_log.list_log(
        t.media_access, t.episodes, t.shows, sort="bytes", direction="asc", limit=40, offset=80
    )


@REGISTRY.add(
    "recent_failures",
    ENRICHED + f" WHERE status_code >= 400 AND {PERIOD} ORDER BY requested_at DESC, a.id DESC LIMIT 10",
    ALL,
)
def _(t):
    return access_log.recent_failures(t.media_access, t.episodes, t.shows, 10, FRM, TO)


@REGISTRY.add(
    "export_rows",
    f"""SELECT strftime(requested_at, '%Y-%m-%dT%H:%M:%S.') || LPAD(CAST(millisecond(requested_at) % 1000 AS VARCHAR), 3, '0') || 'Z' AS requested_at_utc,
  show_title AS show, episode_title AS episode, episode_filename AS filename, kind, CAST(status_code AS VARCHAR) AS status_code,
  CASE WHEN NOT ok THEN 'failed' WHEN incomplete THEN 'partial' ELSE 'ok' END AS result,
  COALESCE(CAST(bytes_sent AS VARCHAR), '') AS bytes_sent, COALESCE(CAST(total_bytes AS VARCHAR), '') AS total_bytes,
  COALESCE(range_header, '') AS range_header, COALESCE(client, '') AS app, COALESCE(error, '') AS error
FROM ({ENRICHED} WHERE {PERIOD} AND {MEDIA})""",
    ALL,
)
def _(t):
    wanted = AccessFilter(frm=FRM, to=TO, kinds=["download", "stream"])
    rows = access_log.with_outcome_flags(access_log.enrich_log(wanted.apply(t.media_access), t.episodes, t.shows))
    return rows.select(*[csv_cell(column).alias(name) for name, column in access_log.export_columns().items()])


@REGISTRY.add("access_extent", "SELECT MIN(requested_at) AS first_at, MAX(requested_at) AS last_at FROM media_access", LOG)
def _(t):
    return access_log.access_extent(t.media_access)


def _stored(t) -> str:
    path = f"{workspace(t.spark, 'stored-log')}/media_access"
    append_log(t.media_access.where("id % 3 <> 0"), path, "first")
    append_log(t.media_access.where("id % 3 = 0"), path, "second")
    return path


@REGISTRY.add("stored_extent", "SELECT MIN(requested_at) AS first_at, MAX(requested_at) AS last_at FROM media_access", LOG)
def _(t):
    return stored_log.stored_extent(t.spark, _stored(t))


@REGISTRY.add(
    "stored_count",
    "SELECT COUNT(*) AS n FROM media_access WHERE requested_at >= TIMESTAMP '2024-01-10' AND requested_at < TIMESTAMP '2024-01-25'",
    LOG,
)
def _(t):
    return stored_log.count_days(t.spark, _stored(t), FRM.date(), TO.date())


@REGISTRY.add("log_without_show", "SELECT * FROM media_access WHERE show_id IS DISTINCT FROM 'show-3'", LOG)
def _(t):
    path = _stored(t)
    stored_log.drop_show(t.spark, path, "show-3")
    return read_log(t.spark, path).select(*t.media_access.columns)


@REGISTRY.add(
    "access_retained",
    "SELECT * FROM media_access WHERE requested_at >= TIMESTAMP '2024-01-10 12:00:00'",
    LOG,
)
def _(t):
    return access_log.trim_access(t.media_access, NOW, days=20)


# --- rollups

TOTALS = f"SELECT episode_id, {MEASURES}, MAX(requested_at) AS last_at FROM media_access WHERE {MEDIA} AND {PERIOD}"


@REGISTRY.add("episode_totals", TOTALS + " GROUP BY episode_id", LOG)
def _(t):
    return rollups.episode_totals(t.media_access, FRM, TO)


@REGISTRY.add("show_episode_totals", TOTALS + " AND show_id = 'show-3' GROUP BY episode_id", LOG)
def _(t):
    return rollups.episode_totals(t.media_access, FRM, TO, show_id="show-3")


@REGISTRY.add("show_rollup", ROLLUP, LOG)
def _(t):
    return rollups.show_rollup(t.media_access, FRM, TO)


@REGISTRY.add(
    "show_stats_zero_filled",
    f"""WITH r AS ({ROLLUP}) SELECT s.id AS show_id, s.slug, s.title, COALESCE(downloads, 0) AS downloads,
  COALESCE(streams, 0) AS streams, COALESCE(failures, 0) AS failures, COALESCE(bytes, 0) AS bytes,
  COALESCE(episodes_touched, 0) AS episodes_touched, last_at, COALESCE(feed_fetches, 0) AS feed_fetches, feed_last_at
FROM shows s LEFT JOIN r ON r.show_id = s.id""",
    ("shows", "media_access"),
)
def _(t):
    return rollups.show_stats(t.shows, t.media_access, FRM, TO)


@REGISTRY.add(
    "last_feed_fetch",
    """SELECT show_id, client AS feed_last_client, requested_at AS feed_last_at FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY show_id ORDER BY requested_at DESC, id DESC) AS r
  FROM media_access WHERE kind = 'feed' AND status_code < 400) WHERE r = 1""",
    LOG,
)
def _(t):
    return rollups.last_feed_fetch(t.media_access)


CARD_CLIENTS = f"""SELECT * FROM (SELECT show_id, client, n,
  CAST(ROW_NUMBER() OVER (PARTITION BY show_id ORDER BY n DESC, client ASC NULLS FIRST) AS INT) AS rank
  FROM (SELECT show_id, client, COUNT(*) AS n FROM media_access WHERE {MEDIA} AND status_code < 400 GROUP BY ALL))
WHERE rank <= 5"""


@REGISTRY.add("show_card_clients", CARD_CLIENTS, LOG)
def _(t):
    return rollups.top_clients(t.media_access)


@REGISTRY.add(
    "show_cards",
    f"""WITH r AS ({ROLLUP}), f AS (SELECT show_id, client AS feed_last_client FROM (SELECT *, ROW_NUMBER() OVER (
  PARTITION BY show_id ORDER BY requested_at DESC, id DESC) AS r FROM media_access WHERE kind = 'feed' AND status_code < 400 AND {PERIOD}) WHERE r = 1),
c AS ({CARD_CLIENTS.replace(f"WHERE {MEDIA} AND", f"WHERE {PERIOD} AND {MEDIA} AND")})
SELECT r.*, f.feed_last_client, c.clients FROM r LEFT JOIN f USING (show_id) LEFT JOIN (
  SELECT show_id, string_agg(COALESCE(client, '?') || '=' || n, ',' ORDER BY rank) AS clients FROM c GROUP BY show_id) c USING (show_id)""",
    LOG,
)
def _(t):
    cards = rollups.show_cards(t.media_access, FRM, TO)
    text = F.transform("clients", lambda c: F.concat(F.coalesce(c["client"], F.lit("?")), F.lit("="), c["n"].cast("string")))
    return cards.withColumn("clients", F.array_join(text, ","))


@REGISTRY.add(
    "overview_all",
    f"""SELECT {MEASURES}, MAX(requested_at) FILTER (WHERE {MEDIA}) AS last_at,
  MAX(requested_at) AS last_ever_at FROM media_access""",
    LOG,
)
def _(t):
    return rollups.overview(t.media_access)


def _compare_columns(name: str) -> str:
    return f"""{name}, prev_{name}, {name} - prev_{name} AS {name}_absolute,
  CASE WHEN prev_{name} <> 0 THEN ROUND(CAST({name} - prev_{name} AS DOUBLE) / prev_{name} * 100, 6) END AS {name}_percent,
  CASE WHEN {name} = prev_{name} THEN 'flat' WHEN {name} > prev_{name} THEN 'up' ELSE 'down' END AS {name}_direction"""


@REGISTRY.add(
    "overview_compare",
    f"""WITH cur AS (SELECT {MEASURES}, MAX(requested_at) FILTER (WHERE {MEDIA}) AS last_at FROM media_access
  WHERE requested_at >= TIMESTAMP '2024-01-20' AND requested_at < TIMESTAMP '2024-01-28'),
prv AS (SELECT downloads AS prev_downloads, streams AS prev_streams, failures AS prev_failures, bytes AS prev_bytes FROM (
  SELECT {MEASURES} FROM media_access WHERE requested_at >= TIMESTAMP '2024-01-12' AND requested_at < TIMESTAMP '2024-01-20'))
SELECT {", ".join(_compare_columns(c) for c in rollups.COUNTERS)}, last_at,
  (SELECT MAX(requested_at) FROM media_access) AS last_ever_at FROM cur, prv""",
    LOG,
)
def _(t):
    out = rollups.overview(t.media_access, datetime(2024, 1, 20), datetime(2024, 1, 28), datetime(2024, 1, 12))
    flat = []
    for c in rollups.COUNTERS:
        change = F.col(f"{c}_change")
        flat += [
            F.col(c),
            F.col(f"prev_{c}"),
            change["absolute"].alias(f"{c}_absolute"),
            F.round(change["percent"], 6).alias(f"{c}_percent"),
            change["direction"].alias(f"{c}_direction"),
        ]
    return out.select(*flat, "last_at", "last_ever_at")


BUSIEST = f"""SELECT a.episode_id, e.title, s.title AS show_title, s.slug AS show_slug,
  COUNT(*) FILTER (WHERE kind = 'download') AS downloads, COUNT(*) FILTER (WHERE kind = 'stream') AS streams,
  CAST(COALESCE(SUM(bytes_sent), 0) AS BIGINT) AS bytes, MAX(requested_at) AS last_at
FROM media_access a JOIN episodes e ON e.id = a.episode_id JOIN shows s ON s.id = a.show_id
WHERE {MEDIA} AND status_code < 400 AND {PERIOD} GROUP BY ALL
ORDER BY downloads DESC, streams DESC, bytes DESC, episode_id LIMIT 10"""


@REGISTRY.add("busiest_episodes", BUSIEST, ALL)
def _(t):
    return rollups.busiest(t.media_access, t.episodes, t.shows, 10, FRM, TO)


BY_CLIENT = f"""SELECT COALESCE(client, 'Unknown') AS client, COUNT(*) FILTER (WHERE kind = 'download') AS downloads,
  COUNT(*) FILTER (WHERE kind = 'stream') AS streams, COUNT(*) AS n, CAST(COALESCE(SUM(bytes_sent), 0) AS BIGINT) AS bytes
FROM media_access WHERE {MEDIA} AND status_code < 400 AND {PERIOD} GROUP BY 1"""


def _buckets(t):
    return buckets.write_buckets(t.media_access, t.episodes, workspace(t.spark, "buckets"), 16)


@REGISTRY.add("bucketed_log_enriched", ENRICHED, ALL)
def _(t):
    return access_log.with_outcome_flags(buckets.enrich_log(_buckets(t), t.shows))


@REGISTRY.add("bucketed_busiest", BUSIEST, ALL)
def _(t):
    return buckets.busiest(_buckets(t), t.shows, 10, FRM, TO)


@REGISTRY.add("by_client", BY_CLIENT, LOG)
def _(t):
    return rollups.by_client(t.media_access, FRM, TO)


# --- series

BUCKETS_SQL = """SELECT CAST(d - DATE '2024-01-10' AS INT) AS idx, CAST(d AS DATE) AS bucket_key,
  strftime(d, '%-d %b') AS label, CAST(d AS TIMESTAMP) + INTERVAL 5 HOUR AS start_at,
  CAST(d AS TIMESTAMP) + INTERVAL 29 HOUR AS end_at
FROM (SELECT CAST(UNNEST(generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-24', INTERVAL 1 DAY)) AS DATE) AS d)"""
SERIES_SQL = f"""WITH buckets AS ({BUCKETS_SQL}),
series AS (SELECT b.idx, b.bucket_key, b.label, b.start_at, b.end_at, {MEASURES}
FROM buckets b LEFT JOIN media_access a ON a.requested_at >= b.start_at AND a.requested_at < b.end_at AND {MEDIA}
GROUP BY ALL)"""
NY_FROM, NY_TO = FRM + timedelta(hours=5), TO + timedelta(hours=5)


def _ny_series(t, show_id=None):
    bounds = t.spark.range(1).select(F.lit(NY_FROM).alias("frm"), F.lit(NY_TO).alias("to"))
    return series.series_for_range(t.media_access, bounds, ZONE, NY_FROM, NY_TO, show_id)


@REGISTRY.add("daily_series", SERIES_SQL + " SELECT * FROM series", LOG, ("bucket_key",))
def _(t):
    return _ny_series(t)


@REGISTRY.add(
    "daily_series_one_show",
    SERIES_SQL.replace(f"AND {MEDIA}\n", f"AND {MEDIA} AND a.show_id = 'show-1'\n") + " SELECT * FROM series",
    LOG,
    ("bucket_key",),
)
def _(t):
    return _ny_series(t, "show-1")


ALL_TIME_TO = "2024-02-01"


@REGISTRY.add(
    "all_time_series",
    f"""WITH d AS (SELECT CAST(UNNEST(generate_series(CAST((SELECT MIN({NY_DAY}) FROM media_access) AS TIMESTAMP), TIMESTAMP '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS d),
b AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY d) - 1 AS INT) AS idx, d AS bucket_key, strftime(d, '%-d %b') AS label,
  CAST(d AS TIMESTAMP) + INTERVAL 5 HOUR AS start_at, CAST(d AS TIMESTAMP) + INTERVAL 29 HOUR AS end_at FROM d)
SELECT b.idx, b.bucket_key, b.label, b.start_at, b.end_at, {MEASURES} FROM b
LEFT JOIN media_access a ON a.requested_at >= b.start_at AND a.requested_at < b.end_at AND {MEDIA} GROUP BY ALL""",
    LOG,
    ("bucket_key",),
)
def _(t):
    bounds = series.chart_bounds(t.media_access, datetime.fromisoformat(ALL_TIME_TO) + timedelta(hours=5))
    return series.series_for_range(t.media_access, bounds, ZONE)


@REGISTRY.add(
    "series_scaled",
    SERIES_SQL
    + """, st AS (SELECT *, downloads + streams + failures AS total FROM series)
SELECT idx, label, total, downloads, streams, failures,
  ROUND(CAST(downloads AS DOUBLE) / (SELECT MAX(total) FROM st) * 100, 6) AS downloads_pct,
  ROUND(CAST(streams AS DOUBLE) / (SELECT MAX(total) FROM st) * 100, 6) AS streams_pct,
  ROUND(CAST(failures AS DOUBLE) / (SELECT MAX(total) FROM st) * 100, 6) AS failures_pct FROM st""",
    LOG,
)
def _(t):
    parts = ["downloads", "streams", "failures"]
    scaled = series.scale_series(_ny_series(t), parts)
    return scaled.select(
        "idx", "label", "total", *parts, *[F.round(f"{p}_pct", 6).alias(f"{p}_pct") for p in parts]
    )


@REGISTRY.add(
    "series_peak",
    SERIES_SQL
    + """, st AS (SELECT *, downloads + streams + failures AS total FROM series)
SELECT MAX(total) AS max_total, CAST(SUM(total) AS BIGINT) AS grand_total,
  (SELECT label FROM st ORDER BY total DESC, idx LIMIT 1) AS peak_label,
  CAST(FLOOR(MAX(total) / 2.0 + 0.5) AS BIGINT) AS mid, MAX(total) = 0 AS empty FROM st""",
    LOG,
)
def _(t):
    return series.series_summary(_ny_series(t), ["downloads", "streams", "failures"])


@REGISTRY.add(
    "client_shares",
    f"""WITH c AS ({BY_CLIENT}), k AS (SELECT client AS label, n AS value FROM c WHERE n > 0 ORDER BY n DESC, client LIMIT 4)
SELECT label, value, CAST(ROW_NUMBER() OVER (ORDER BY value DESC, label) AS INT) AS rank,
  ROUND(CAST(value AS DOUBLE) / MAX(value) OVER () * 100, 6) AS pct, CAST((SELECT SUM(n) FROM c) AS BIGINT) AS total,
  CAST(FLOOR(CAST(value AS DOUBLE) / (SELECT SUM(n) FROM c) * 100 + 0.5) AS BIGINT) AS share,
  CAST((SELECT SUM(n) FROM c) - SUM(value) OVER () AS BIGINT) AS other, label IN ('Unknown', 'Other') AS vague FROM k""",
    LOG,
)
def _(t):
    bars = series.share_bars(rollups.by_client(t.media_access, FRM, TO), "client", "n", 4)
    return bars.withColumn("pct", F.round("pct", 6))


# --- calendar

def _midnight(day: str) -> str:
    """UTC instant of a local midnight: summer time of 2023 ran from 13 March to 5 November."""
    hours = f"CASE WHEN CAST({day} AS DATE) BETWEEN DATE '2023-03-13' AND DATE '2023-11-05' THEN 4 ELSE 5 END"
    return f"CAST({day} AS TIMESTAMP) + to_hours({hours})"


RANGES_SQL = " UNION ALL ".join(
    f"""SELECT show_id, '{key}' AS range_key, {_midnight(f"(d - INTERVAL {days - 1} DAY)")} AS range_from,
  {_midnight("(d + INTERVAL 1 DAY)")} AS range_to, {_midnight(f"(d - INTERVAL {2 * days - 1} DAY)")} AS prev_from FROM l"""
    for key, days in (("7d", 7), ("30d", 30), ("90d", 90))
)


@REGISTRY.add(
    "range_bounds",
    f"WITH l AS (SELECT show_id, CAST(MAX(requested_at) - INTERVAL 5 HOUR AS DATE) AS d FROM media_access GROUP BY show_id) {RANGES_SQL}",
    LOG,
)
def _(t):
    last = t.media_access.groupBy("show_id").agg(F.max("requested_at").alias("at"))
    frames = [
        last.select("show_id", F.lit(key).alias("range_key"), *[c.alias(n) for n, c in range_columns(key, F.col("at"), ZONE).items()])
        for key in ("7d", "30d", "90d")
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@REGISTRY.add(
    "calendar_buckets",
    f"""WITH x AS (SELECT show_id, MIN({NY_DAY}) AS d0, MAX({NY_DAY}) + 1 AS d1 FROM media_access GROUP BY ALL),
g AS (SELECT MIN(d0) AS d0, MAX(d1) AS d1 FROM x),
s AS (SELECT CAST(UNNEST(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 - 1 AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS d, d1 FROM g)
SELECT CAST(ROW_NUMBER() OVER (ORDER BY d) - 1 AS INT) AS idx, d AS bucket_key, strftime(d, '%-d %b') AS label,
  CAST(d AS TIMESTAMP) + INTERVAL 5 HOUR AS start_at,
  CAST(COALESCE(LEAD(d) OVER (ORDER BY d), d1) AS TIMESTAMP) + INTERVAL 5 HOUR AS end_at FROM s""",
    LOG,
    ("bucket_key",),
)
def _(t):
    upper = local_midnight(F.date_add(local_date(F.max("requested_at"), ZONE), 1), ZONE)
    bounds = t.media_access.agg(F.min("requested_at").alias("frm"), upper.alias("to"))
    return calendar_buckets(bounds, ZONE, max_buckets=10).drop("next_key")
