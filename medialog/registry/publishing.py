"""Registered queries over readiness, marts and feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialog.functions import moments
from medialog.functions.numbers import format_bytes
from medialog.operators import feeds, readiness
from medialog.operators.catalogue import episode_counts
from medialog.plans.episode_overview import episode_overview
from medialog.plans.show_overview import show_overview
from medialog.registry.access import MEASURES, MEDIA
from medialog.registry.catalogue import COUNTS_SQL, LIVE, NOW_SQL
from medialog.registry.core import NOW, REGISTRY
from medialog.session import workspace
from medialog.sources.export import write_feeds

BASE = "https://pods.example.com/x/"
BASE_SQL = "https://pods.example.com/x"

# --- readiness

BLANK = "COALESCE(trim({0}), '') = ''"
CHECKS_SQL = f"""rd AS (SELECT s.*, COALESCE(c.active, 0) AS active, COALESCE(c.missing, 0) AS missing, COALESCE(c.scheduled, 0) AS scheduled,
    COALESCE(c.in_feed, 0) AS in_feed, COALESCE(c.in_feed_no_duration, 0) AS nodur, COALESCE(c.total, 0) AS total
  FROM shows s LEFT JOIN ({COUNTS_SQL}) c ON c.show_id = s.id),
sz AS (SELECT id, CASE WHEN cover_width <> cover_height THEN 'not square' END AS sq,
    CASE WHEN cover_width < 1400 OR cover_height < 1400 THEN 'smaller than 1400px' WHEN cover_width > 3000 OR cover_height > 3000 THEN 'larger than 3000px' END AS px FROM shows),
ck AS (
  SELECT id, 0 AS o, 'base_url' AS check_id, 'error' AS level, TRUE AS ok, NULL AS reason FROM rd
  UNION ALL SELECT id, 1, 'folder_present', 'error', status <> 'folder_missing', CASE WHEN status = 'folder_missing' THEN 'folder_missing' END FROM rd
  UNION ALL SELECT id, 2, 'episodes_present', 'error', in_feed > 0, CASE WHEN in_feed > 0 THEN NULL WHEN total = 0 THEN 'no_episodes'
    WHEN scheduled > 0 AND scheduled = active THEN 'all_scheduled' ELSE 'none_in_feed' END FROM rd
  UNION ALL SELECT id, 3, 'artwork_present', 'error', cover_filename IS NOT NULL, CASE WHEN cover_filename IS NULL THEN 'missing' END FROM rd
  UNION ALL SELECT id, 4, 'artwork_format', 'error', COALESCE(cover_format IN ('jpeg', 'png'), FALSE),
    CASE WHEN cover_format IS NULL THEN 'unreadable' WHEN cover_format NOT IN ('jpeg', 'png') THEN 'format_' || cover_format END FROM rd WHERE cover_filename IS NOT NULL
  UNION ALL SELECT rd.id, 5, 'artwork_size', 'error', sq IS NULL AND px IS NULL, CASE WHEN sq IS NOT NULL AND px IS NOT NULL THEN sq || ' and ' || px ELSE COALESCE(sq, px) END
    FROM rd JOIN sz ON sz.id = rd.id WHERE cover_filename IS NOT NULL AND cover_width > 0 AND cover_height > 0
  UNION ALL SELECT id, 6, 'description', 'error', NOT {BLANK.format('description')}, CASE WHEN {BLANK.format('description')} THEN 'missing' END FROM rd
  UNION ALL SELECT id, 7, 'owner_email', 'error', NOT {BLANK.format('author_email')}, CASE WHEN {BLANK.format('author_email')} THEN 'missing' END FROM rd
  UNION ALL SELECT id, 8, 'category', 'error', itunes_category IN ('Technology', 'Arts'), CASE WHEN itunes_category NOT IN ('Technology', 'Arts') THEN 'not_in_list' END FROM rd
  UNION ALL SELECT id, 9, 'directory_listing', 'error', directory_listing <> 'blocked', CASE WHEN directory_listing = 'blocked' THEN 'blocked' END FROM rd
  UNION ALL SELECT id, 10, 'author_name', 'warn', NOT {BLANK.format('author_name')}, CASE WHEN {BLANK.format('author_name')} THEN 'missing' END FROM rd
  UNION ALL SELECT id, 11, 'episode_durations', 'warn', nodur = 0, CASE WHEN nodur > 0 THEN nodur || ' of ' || in_feed END FROM rd WHERE in_feed > 0
  UNION ALL SELECT id, 12, 'episodes_on_disk', 'warn', missing = 0, CASE WHEN missing > 0 THEN CAST(missing AS VARCHAR) END FROM rd WHERE in_feed > 0)"""
BOTH = ("shows", "episodes")


@REGISTRY.add(
    "readiness_checks",
    f"""WITH {CHECKS_SQL} SELECT id AS show_id, CAST(ROW_NUMBER() OVER (PARTITION BY id ORDER BY o) - 1 AS INT) AS position,
  check_id, level, ok, reason FROM ck""",
    BOTH,
)
def _(t):
    return readiness.readiness_checks(t.shows, episode_counts(t.episodes, NOW), BASE_SQL)


SUMMARY_SQL = """SELECT id AS show_id, COUNT(*) FILTER (WHERE NOT ok AND level = 'error') = 0 AS ready,
  CAST(COUNT(*) FILTER (WHERE NOT ok AND level = 'error') AS INT) AS blocking,
  CAST(COUNT(*) FILTER (WHERE NOT ok AND level = 'warn') AS INT) AS advisory FROM ck GROUP BY id"""


@REGISTRY.add("readiness_summary", f"WITH {CHECKS_SQL} {SUMMARY_SQL}", BOTH)
def _(t):
    return readiness.readiness_summary(t.shows, episode_counts(t.episodes, NOW), BASE_SQL)


JSON_LEN = "CASE WHEN {0} LIKE '[%' THEN CAST(json_array_length({0}) AS INT) ELSE 0 END"


@REGISTRY.add(
    "show_overview",
    f"""WITH {CHECKS_SQL}, sm AS ({SUMMARY_SQL}),
bw AS (SELECT id, string_agg(check_id, ',' ORDER BY o) AS warnings FROM ck
  WHERE NOT ok AND check_id IN ('folder_present', 'artwork_present', 'artwork_size', 'owner_email', 'author_name') GROUP BY id),
ls AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY show_id ORDER BY started_at DESC, id DESC) AS r FROM scan_log
  WHERE show_id IS NOT NULL AND finished_at IS NOT NULL) WHERE r = 1),
ag AS (SELECT show_id, {MEASURES}, COUNT(DISTINCT episode_id) FILTER (WHERE {MEDIA}) AS episodes_touched,
  MAX(requested_at) FILTER (WHERE {MEDIA}) AS last_at, COUNT(*) FILTER (WHERE kind = 'feed' AND status_code < 400) AS feed_fetches,
  MAX(requested_at) FILTER (WHERE kind = 'feed' AND status_code < 400) AS feed_last_at FROM media_access GROUP BY show_id),
fl AS (SELECT show_id, client FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY show_id ORDER BY requested_at DESC, id DESC) AS r
  FROM media_access WHERE kind = 'feed' AND status_code < 400) WHERE r = 1)
SELECT s.id AS show_id, s.slug, s.title, s.status, COALESCE(c.active, 0) AS active, COALESCE(c.missing, 0) AS missing,
  COALESCE(c.removed, 0) AS removed, COALESCE(c.expired, 0) AS expired, COALESCE(c.scheduled, 0) AS scheduled,
  COALESCE(c.in_feed, 0) AS in_feed, COALESCE(c.in_feed_no_duration, 0) AS in_feed_no_duration, COALESCE(c.total, 0) AS total,
  sm.ready, sm.blocking, sm.advisory, COALESCE(bw.warnings, '') AS warnings,
  CASE WHEN COALESCE({JSON_LEN.format('ls.errors_json')}, 0) > 0 THEN 'error' WHEN bw.warnings IS NOT NULL THEN 'warn' ELSE 'ok' END AS health,
  ls.id AS scan_id, ls.finished_at AS scan_finished_at, ls.trigger AS scan_trigger, ls.added AS scan_added,
  CASE WHEN ls.id IS NOT NULL THEN {JSON_LEN.format('ls.errors_json')} END AS scan_errors,
  CASE WHEN ls.id IS NOT NULL THEN {JSON_LEN.format('ls.warnings_json')} END AS scan_warnings,
  COALESCE(ag.downloads, 0) AS downloads, COALESCE(ag.streams, 0) AS streams, COALESCE(ag.failures, 0) AS failures,
  COALESCE(ag.bytes, 0) AS bytes, COALESCE(ag.episodes_touched, 0) AS episodes_touched, ag.last_at,
  COALESCE(ag.feed_fetches, 0) AS feed_fetches, ag.feed_last_at, fl.client AS feed_last_client,
  '{BASE_SQL}/feeds/' || s.slug || '/' || REPLACE(s.feed_token, ' ', '%20') || '.xml' AS feed_url
FROM shows s LEFT JOIN ({COUNTS_SQL}) c ON c.show_id = s.id JOIN sm ON sm.show_id = s.id LEFT JOIN bw ON bw.id = s.id
LEFT JOIN ls ON ls.show_id = s.id LEFT JOIN ag ON ag.show_id = s.id LEFT JOIN fl ON fl.show_id = s.id""",
    ("shows", "episodes", "scan_log", "media_access"),
)
def _(t):
    return show_overview(t.shows, t.episodes, t.scan_log, t.media_access, BASE, NOW)


# --- feeds

TOKEN = "REPLACE(s.feed_token, ' ', '%20')"
COVER = f"'{BASE_SQL}/media/' || s.slug || '/' || {TOKEN} || '/cover.jpg?v=2024-01-04T00%3A00%3A00.000Z'"
ITEMS_SQL = f"""it AS (SELECT e.show_id, s.slug, e.id AS episode_id, e.title, e.description, e.pub_date, e.created_at, e.updated_at,
  CASE WHEN e.duration_seconds IS NOT NULL THEN printf('%02d:%02d:%02d', e.duration_seconds // 3600, (e.duration_seconds % 3600) // 60, e.duration_seconds % 60) END AS duration,
  CASE WHEN COALESCE(e.explicit, s.explicit) = 1 THEN 'true' ELSE 'false' END AS explicit, e.season, e.episode_number, e.episode_type,
  CASE WHEN e.art_filename IS NOT NULL THEN '{BASE_SQL}/media/' || s.slug || '/' || {TOKEN} || '/' || e.id || '/cover.jpg?v=' || e.art_etag
    WHEN s.cover_filename IS NOT NULL THEN {COVER} END AS image_url,
  '{BASE_SQL}/media/' || s.slug || '/' || {TOKEN} || '/' || e.id || '/' || e.filename AS enclosure_url,
  e.file_size_bytes AS enclosure_length, e.mime_type AS enclosure_type
FROM episodes e JOIN shows s ON s.id = e.show_id WHERE s.status <> 'folder_missing' AND e.{LIVE} AND e.pub_date <= {NOW_SQL})"""


@REGISTRY.add("feed_items", f"WITH {ITEMS_SQL} SELECT * FROM it", BOTH)
def _(t):
    return feeds.feed_items(t.episodes, t.shows, BASE, NOW)


BUILD_SQL = f"""lb AS (SELECT s.id AS show_id, COUNT(it.episode_id) AS items,
  LEAST(GREATEST(MAX(s.updated_at), COALESCE(MAX(it.pub_date), TIMESTAMP '1970-01-01'), COALESCE(MAX(it.updated_at), TIMESTAMP '1970-01-01')), {NOW_SQL}) AS last_build_at
FROM shows s LEFT JOIN it ON it.show_id = s.id WHERE s.status <> 'folder_missing' GROUP BY s.id)"""


@REGISTRY.add("feed_last_build", f"WITH {ITEMS_SQL}, {BUILD_SQL} SELECT * FROM lb", BOTH)
def _(t):
    return feeds.last_build(t.episodes, t.shows, BASE, NOW)


def _esc(x: str) -> str:
    return f"REPLACE(REPLACE(REPLACE({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


RFC = "strftime({0}, '%a, %d %b %Y %H:%M:%S GMT')"
LINES_SQL = f"""ln AS (SELECT show_id, slug, 1 AS section, '<item><title>' || {_esc('title')} || '</title><description>' || {_esc('description')} || '</description>'
  || CASE WHEN description <> '' THEN '<content:encoded><![CDATA[' || description || ']]></content:encoded>' ELSE '' END
  || '<guid isPermaLink="false">' || episode_id || '</guid><pubDate>' || {RFC.format('pub_date')} || '</pubDate>'
  || COALESCE('<itunes:duration>' || duration || '</itunes:duration>', '') || '<itunes:explicit>' || explicit || '</itunes:explicit>'
  || COALESCE('<itunes:season>' || season || '</itunes:season>', '') || COALESCE('<itunes:episode>' || episode_number || '</itunes:episode>', '')
  || '<itunes:episodeType>' || episode_type || '</itunes:episodeType>' || COALESCE('<itunes:image href="' || image_url || '"/>', '')
  || '<enclosure url="' || enclosure_url || '" length="' || enclosure_length || '" type="' || enclosure_type || '"/></item>' AS line,
  pub_date, created_at, episode_id FROM it
UNION ALL SELECT s.id, s.slug, 0, '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:itunes="http://www.itunes.com/dtds/podcast-1.0.dtd" xmlns:podcast="https://podcastindex.org/namespace/1.0" xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>'
  || s.title || '</title><link>{BASE_SQL}</link><description>' || s.description || '</description><language>' || s.language || '</language><itunes:author>'
  || COALESCE(NULLIF(trim(s.author_name), ''), s.title) || '</itunes:author><itunes:summary>' || s.description || '</itunes:summary><itunes:owner><itunes:name>'
  || COALESCE(NULLIF(trim(s.author_name), ''), s.title) || '</itunes:name>' || COALESCE('<itunes:email>' || NULLIF(s.author_email, '') || '</itunes:email>', '')
  || '</itunes:owner><itunes:category text="' || s.itunes_category || '">' || COALESCE('<itunes:category text="' || s.itunes_subcategory || '"/>', '') || '</itunes:category><itunes:explicit>'
  || CASE WHEN s.explicit = 1 THEN 'true' ELSE 'false' END || '</itunes:explicit><itunes:type>' || s.itunes_type || '</itunes:type>'
  || CASE WHEN s.directory_listing = 'blocked' THEN '<itunes:block>Yes</itunes:block>' ELSE '' END
  || CASE WHEN s.cover_filename IS NOT NULL THEN '<itunes:image href="' || {COVER} || '"/><image><url>' || {COVER} || '</url><title>' || s.title || '</title><link>{BASE_SQL}</link></image>' ELSE '' END
  || '<podcast:locked' || COALESCE(' owner="' || NULLIF(s.author_email, '') || '"', '') || '>yes</podcast:locked><podcast:guid>' || s.id
  || '</podcast:guid><generator>medialog</generator><lastBuildDate>' || {RFC.format('lb.last_build_at')} || '</lastBuildDate><atom:link href="{BASE_SQL}/feeds/'
  || s.slug || '/' || {TOKEN} || '.xml" rel="self" type="application/rss+xml"/>', NULL, NULL, NULL FROM shows s JOIN lb ON lb.show_id = s.id
UNION ALL SELECT s.id, s.slug, 2, '</channel></rss>', NULL, NULL, NULL FROM shows s JOIN lb ON lb.show_id = s.id)"""
FEED_SQL = f"WITH {ITEMS_SQL}, {BUILD_SQL}, {LINES_SQL}"


@REGISTRY.add("feed_document_lines", f"{FEED_SQL} SELECT * FROM ln", BOTH)
def _(t):
    return feeds.feed_lines(t.episodes, t.shows, BASE, NOW)


@REGISTRY.add("feed_files", f"{FEED_SQL} SELECT slug, line FROM ln", BOTH)
def _(t):
    path = workspace(t.spark, "feeds")
    # Ordering goes through its rows more than once; they are rendered once.
    rendered = workspace(t.spark, "feed-lines")
    feeds.feed_lines(t.episodes, t.shows, BASE, NOW).write.parquet(rendered)
    write_feeds(t.spark.read.parquet(rendered), path)
    return t.spark.read.schema("line STRING, slug STRING").text(path).select("slug", "line")


PARTS = [f"CAST('0x' || substr(sha256(line), {1 + 15 * i}, 15) AS BIGINT)" for i in range(4)]
SUMS = " || '|' || ".join(f"CAST(SUM({p}) AS VARCHAR)" for p in PARTS)
XORS = " || '|' || ".join(f"CAST(BIT_XOR({p}) AS VARCHAR)" for p in PARTS)
VERSION_SQL = f"""vs AS (SELECT show_id, COUNT(*) AS lines, CAST(SUM(strlen(line)) AS BIGINT) AS bytes,
  substr(sha256(COUNT(*) || '|' || {SUMS} || '|' || {XORS}), 1, 32) AS version FROM ln GROUP BY show_id)"""


@REGISTRY.add("feed_document_summary", f"{FEED_SQL}, {VERSION_SQL} SELECT * FROM vs", BOTH)
def _(t):
    return feeds.feed_versions(feeds.feed_lines(t.episodes, t.shows, BASE, NOW))


@REGISTRY.add(
    "feed_version_state",
    f"""{FEED_SQL}, {VERSION_SQL},
old AS (SELECT show_id, CASE WHEN CAST(REPLACE(show_id, 'show-', '') AS INT) % 3 = 0 THEN version ELSE 'stale' END AS version,
  CASE WHEN CAST(REPLACE(show_id, 'show-', '') AS INT) % 3 = 1 THEN TIMESTAMP '2024-01-30 00:00:00' ELSE TIMESTAMP '2024-01-02 00:00:00' END AS modified_at
  FROM vs WHERE CAST(REPLACE(show_id, 'show-', '') AS INT) % 5 <> 4)
SELECT vs.show_id, vs.version, date_trunc('second', CASE WHEN old.version = vs.version THEN old.modified_at
  WHEN lb.last_build_at <= old.modified_at THEN {NOW_SQL} ELSE lb.last_build_at END) AS modified_at,
  old.version IS NULL OR old.version <> vs.version AS changed
FROM vs JOIN lb ON lb.show_id = vs.show_id LEFT JOIN old ON old.show_id = vs.show_id""",
    BOTH,
)
def _(t):
    from datetime import datetime

    lines = feeds.feed_lines(t.episodes, t.shows, BASE, NOW)
    built = feeds.last_build(t.episodes, t.shows, BASE, NOW)
    versions = feeds.feed_versions(lines)
    current = versions.select("show_id", "version").join(built.select("show_id", "last_build_at"), "show_id")
    n = F.replace("show_id", F.lit("show-"), F.lit("")).cast("int")
    state = versions.where(n % 5 != 4).select(
        "show_id",
        F.when(n % 3 == 0, F.col("version")).otherwise("stale").alias("version"),
        F.when(n % 3 == 1, F.lit(datetime(2024, 1, 30))).otherwise(F.lit(datetime(2024, 1, 2))).alias("modified_at"),
    )
    return feeds.advance_versions(current, state, NOW)


@REGISTRY.add(
    "episode_overview",
    f"""WITH ag AS (SELECT episode_id, {MEASURES}, MAX(requested_at) AS last_at FROM media_access WHERE {MEDIA} GROUP BY episode_id)
SELECT e.id AS episode_id, e.show_id, s.slug AS show_slug, e.filename, e.title, e.title_is_custom = 1 AS title_is_custom, e.season,
  e.episode_number, e.episode_type, COALESCE(e.explicit, s.explicit) = 1 AS resolved_explicit, e.pub_date, e.duration_seconds,
  e.file_size_bytes, e.status, e.{LIVE} AND e.pub_date > {NOW_SQL} AS scheduled, e.missing_since, e.removed_at,
  '{BASE_SQL}/media/' || s.slug || '/' || {TOKEN} || '/' || e.id || '/' || e.filename AS media_url,
  CASE WHEN e.art_filename IS NOT NULL THEN '{BASE_SQL}/media/' || s.slug || '/' || {TOKEN} || '/' || e.id || '/cover.jpg?v=' || e.art_etag END AS art_url,
  CAST(NULL AS VARCHAR) AS art_problems, COALESCE(ag.downloads, 0) AS downloads, COALESCE(ag.streams, 0) AS streams,
  COALESCE(ag.failures, 0) AS failures, COALESCE(ag.bytes, 0) AS bytes, ag.last_at
FROM episodes e JOIN shows s ON s.id = e.show_id LEFT JOIN ag ON ag.episode_id = e.id""",
    ("shows", "episodes", "media_access"),
)
def _(t):
    return episode_overview(t.episodes, t.shows, t.media_access, BASE, NOW)


# --- display text

HALF_UP = "printf('%.1f', FLOOR(CAST({0} AS DOUBLE) * 10 + 0.5) / 10)"


@REGISTRY.add(
    "display_text",
    f"""SELECT id, strftime(pub_date, '%a, %d %b %Y %H:%M:%S GMT') AS published,
  CASE WHEN duration_seconds IS NOT NULL THEN CASE WHEN duration_seconds >= 3600 THEN printf('%d:%02d:%02d', duration_seconds // 3600, duration_seconds % 3600 // 60, duration_seconds % 60)
    ELSE printf('%d:%02d', duration_seconds // 60, duration_seconds % 60) END END AS duration,
  CASE WHEN b < 1024 THEN CAST(b AS VARCHAR) || ' B' WHEN b < 1048576 THEN {HALF_UP.format('b / 1024.0')} || ' KB'
    WHEN b < 1073741824 THEN {HALF_UP.format('b / 1048576.0')} || ' MB' ELSE {HALF_UP.format('b / 1073741824.0')} || ' GB' END AS size,
  CASE WHEN pub_date = {NOW_SQL} THEN 'just now' WHEN abs(s) < 79200 THEN CASE WHEN s < 0 THEN h || CASE WHEN h = 1 THEN ' hour ago' ELSE ' hours ago' END ELSE 'in ' || h || CASE WHEN h = 1 THEN ' hour' ELSE ' hours' END END
    WHEN abs(s) < 2246400 THEN CASE WHEN s < 0 THEN d || CASE WHEN d = 1 THEN ' day ago' ELSE ' days ago' END ELSE 'in ' || d || CASE WHEN d = 1 THEN ' day' ELSE ' days' END END
    ELSE CASE WHEN s < 0 THEN m || CASE WHEN m = 1 THEN ' month ago' ELSE ' months ago' END ELSE 'in ' || m || CASE WHEN m = 1 THEN ' month' ELSE ' months' END END END AS age
FROM (SELECT *, file_size_bytes * (CAST(REPLACE(id, 'ep-', '') AS BIGINT) % 100 + 1) // 3333 AS b, s, CAST(abs(floor(s / 3600.0 + 0.5)) AS BIGINT) AS h,
  CAST(abs(floor(s / 86400.0 + 0.5)) AS BIGINT) AS d, CAST(abs(floor(s / 2592000.0 + 0.5)) AS BIGINT) AS m
  FROM (SELECT *, epoch(pub_date) - epoch({NOW_SQL}) AS s FROM episodes))""",
    ("episodes",),
)
def _(t):
    size = F.expr("file_size_bytes * (CAST(REPLACE(id, 'ep-', '') AS BIGINT) % 100 + 1) DIV 3333")
    return t.episodes.select(
        "id",
        moments.rfc2822(F.col("pub_date")).alias("published"),
        moments.short_duration(F.col("duration_seconds")).alias("duration"),
        format_bytes(size).alias("size"),
        moments.relative_time(F.col("pub_date"), moments.instant(NOW)).alias("age"),
    )
