"""Registered queries over the catalogue and its changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from medialog.functions.text import file_class, title_from_filename
from medialog.operators import artwork, catalogue, categories, discover, lifecycle, patches, settings, timeline
from medialog.operators.reconcile import conform, duplicate_files, reconcile
from medialog.registry.core import NOW, REGISTRY
from medialog.schemas import LISTING
from medialog.session import workspace

SCAN_NOW = datetime(2024, 2, 2)
NOW_SQL = "TIMESTAMP '2024-01-30 12:00:00'"
SCAN_SQL = "TIMESTAMP '2024-02-02'"
LIVE = "status IN ('active', 'missing')"
COUNTS_SQL = f"""SELECT show_id,
  COUNT(*) FILTER (WHERE status = 'active') AS active, COUNT(*) FILTER (WHERE status = 'missing') AS missing,
  COUNT(*) FILTER (WHERE status = 'removed') AS removed, COUNT(*) FILTER (WHERE status = 'expired') AS expired,
  COUNT(*) FILTER (WHERE {LIVE} AND pub_date > {NOW_SQL}) AS scheduled,
  COUNT(*) FILTER (WHERE {LIVE} AND pub_date <= {NOW_SQL}) AS in_feed,
  COUNT(*) FILTER (WHERE {LIVE} AND pub_date <= {NOW_SQL} AND duration_seconds IS NULL) AS in_feed_no_duration,
  COUNT(*) AS total FROM episodes GROUP BY show_id"""


@REGISTRY.add("episode_counts", COUNTS_SQL, ("episodes",))
def _(t):
    return catalogue.episode_counts(t.episodes, NOW)


@REGISTRY.add(
    "scheduled_episodes",
    f"SELECT id, show_id, pub_date, {LIVE} AND pub_date > {NOW_SQL} AS scheduled FROM episodes",
    ("episodes",),
)
def _(t):
    return t.episodes.select("id", "show_id", "pub_date", catalogue.is_scheduled(NOW).alias("scheduled"))


@REGISTRY.add(
    "show_list",
    "SELECT id, slug, title FROM shows ORDER BY translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), id",
    ("shows",),
)
def _(t):
    return catalogue.list_shows(t.shows).select("id", "slug", "title")


# Two names per show, hence several rows with one name.
SHARED_NAMES = """SELECT id, show_id, CASE WHEN id LIKE '%1' THEN 'a.mp3' WHEN id LIKE '%7' THEN 'b.mp3' ELSE filename END AS filename,
  status, updated_at FROM episodes"""


@REGISTRY.add(
    "live_row_per_filename",
    f"""SELECT id, show_id, filename, status, updated_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY show_id, filename
  ORDER BY CASE status WHEN 'active' THEN 0 WHEN 'missing' THEN 1 WHEN 'expired' THEN 2 ELSE 3 END, updated_at DESC, id) AS r
  FROM ({SHARED_NAMES})) WHERE r = 1""",
    ("episodes",),
)
def _(t):
    named = F.when(F.col("id").endswith("1"), "a.mp3").when(F.col("id").endswith("7"), "b.mp3").otherwise(F.col("filename"))
    rows = t.episodes.select("id", "show_id", named.alias("filename"), "status", "updated_at")
    return catalogue.live_row_per_filename(rows)


# --- timeline

EVENTS_SQL = """WITH ev AS (
  SELECT id AS episode_id, show_id, title AS episode_title, filename, status, 'added' AS event, created_at AS event_at FROM episodes
  UNION ALL SELECT id, show_id, title, filename, status, 'missing', missing_since FROM episodes WHERE missing_since IS NOT NULL
  UNION ALL SELECT id, show_id, title, filename, status, CASE status WHEN 'expired' THEN 'expired' ELSE 'removed' END, removed_at
    FROM episodes WHERE removed_at IS NOT NULL AND status IN ('removed', 'expired'))
SELECT ev.*, s.title AS show_title, s.slug AS show_slug FROM ev JOIN shows s ON s.id = ev.show_id"""
BOTH = ("shows", "episodes")


@REGISTRY.add("episode_timeline", EVENTS_SQL, BOTH)
def _(t):
    return timeline.episode_timeline(t.episodes, t.shows)


@REGISTRY.add(
    "timeline_filtered",
    EVENTS_SQL + " WHERE event IN ('missing', 'expired') AND event_at >= TIMESTAMP '2024-01-11' AND event_at < TIMESTAMP '2024-01-17'",
    BOTH,
)
def _(t):
    return timeline.episode_timeline(
        t.episodes, t.shows, kinds=["missing", "expired", "junk"], frm=datetime(2024, 1, 11), to=datetime(2024, 1, 17)
    )


@REGISTRY.add("timeline_page", EVENTS_SQL + " ORDER BY event_at DESC, episode_id DESC, event LIMIT 30 OFFSET 60", BOTH)
def _(t):
    return timeline.page_timeline(timeline.episode_timeline(t.episodes, t.shows), 30, 60)


@REGISTRY.add("timeline_count", f"SELECT COUNT(*) AS n FROM ({EVENTS_SQL})", BOTH)
def _(t):
    return timeline.count_timeline(t.episodes, t.shows)


# --- listing

EXT_SQL = r"lower(regexp_extract(filename, '(\.[^.]*)$', 1))"
AUDIO_SQL = f"{EXT_SQL} IN ('.mp3', '.m4a', '.aac', '.ogg', '.opus', '.wav', '.flac')"
IMAGE_SQL = f"{EXT_SQL} IN ('.jpg', '.jpeg', '.png', '.webp')"
STEM_SQL = r"lower(regexp_replace(filename, '^(.+)\.[^.]*$', '\1'))"


@REGISTRY.add(
    "classify_listing",
    f"""SELECT show_id, filename, CASE WHEN {AUDIO_SQL} THEN 'audio' WHEN {IMAGE_SQL} THEN 'image'
  WHEN {EXT_SQL} IN ('', '.gif', '.txt', '.md', '.json', '.nfo', '.pdf', '.srt', '.vtt', '.cue', '.log', '.tmp', '.part', '.crdownload', '.db', '.ini')
  THEN 'ignored' ELSE 'unsupported' END AS file_class FROM file_listing""",
    ("file_listing",),
)
def _(t):
    return t.file_listing.select("show_id", "filename", file_class(F.col("filename")).alias("file_class"))


@REGISTRY.add(
    "titles_from_filenames",
    r"""SELECT filename, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(filename, '\.[^.]+$', ''), '[\s_\-]+', ' ', 'g')), ' '),
  lambda w: CASE WHEN regexp_matches(w, '^[A-Z0-9]+$') THEN w ELSE upper(w[1]) || w[2:] END), ' ') AS title FROM file_listing""",
    ("file_listing",),
)
def _(t):
    return t.file_listing.select("filename", title_from_filename(F.col("filename")).alias("title"))


@REGISTRY.add(
    "sidecar_art",
    f"""WITH i AS (SELECT show_id, {STEM_SQL} AS stem, filename, mtime, ROW_NUMBER() OVER (PARTITION BY show_id, {STEM_SQL}
  ORDER BY CASE {EXT_SQL} WHEN '.jpg' THEN 0 WHEN '.jpeg' THEN 1 WHEN '.png' THEN 2 ELSE 3 END, filename) AS r
  FROM file_listing WHERE {IMAGE_SQL}), a AS (SELECT show_id, filename, {STEM_SQL} AS stem FROM file_listing WHERE {AUDIO_SQL})
SELECT a.show_id, a.filename, i.filename AS sidecar_name, i.mtime AS sidecar_mtime FROM a JOIN i USING (show_id, stem) WHERE r = 1""",
    ("file_listing",),
)
def _(t):
    return artwork.sidecar_art(t.file_listing)


@REGISTRY.add(
    "cover_pick",
    """SELECT show_id, filename AS cover_filename FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY show_id ORDER BY
  list_position(['cover.jpg', 'cover.jpeg', 'cover.png', 'cover.webp', 'folder.jpg', 'artwork.jpg'], lower(filename)), filename) AS r
  FROM file_listing WHERE lower(filename) IN ('cover.jpg', 'cover.jpeg', 'cover.png', 'cover.webp', 'folder.jpg', 'artwork.jpg')) WHERE r = 1""",
    ("file_listing",),
)
def _(t):
    return artwork.cover_pick(t.file_listing)


# --- reconciliation

CLAIMS_SQL = f"""af AS (SELECT show_id, filename, size_bytes, mtime, identity_key, 'audio/mpeg' AS mime_type FROM file_listing WHERE {AUDIO_SQL}),
live AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY show_id, filename ORDER BY
  CASE status WHEN 'active' THEN 0 WHEN 'missing' THEN 1 WHEN 'expired' THEN 2 ELSE 3 END, updated_at DESC, id) AS r FROM episodes) WHERE r = 1),
ff AS (SELECT af.* EXCLUDE (identity_key), COALESCE(l.file_size_bytes = af.size_bytes AND l.file_mtime = af.mtime AND l.mime_type = af.mime_type, FALSE) AS fast,
  CASE WHEN l.file_size_bytes = af.size_bytes AND l.file_mtime = af.mtime AND l.mime_type = af.mime_type THEN l.identity_key ELSE af.identity_key END AS identity_key
  FROM af LEFT JOIN live l ON l.show_id = af.show_id AND l.filename = af.filename),
ranked AS (SELECT ff.*, ROW_NUMBER() OVER w AS r, FIRST_VALUE(ff.filename) OVER w AS claimed_by
  FROM ff LEFT JOIN episodes k ON k.show_id = ff.show_id AND k.identity_key = ff.identity_key AND k.filename = ff.filename
  WINDOW w AS (PARTITION BY ff.show_id, ff.identity_key ORDER BY fast DESC, k.id IS NULL, ff.filename)),
verdict AS (SELECT COALESCE(e.show_id, c.show_id) AS show_id, COALESCE(e.identity_key, c.identity_key) AS identity_key, e.id,
  e.status AS status_before, c.filename AS new_name, e.filename AS old_name, c.show_id IS NOT NULL AS seen, c.fast,
  c.size_bytes, e.file_size_bytes, c.mtime, e.file_mtime,
  CASE WHEN e.id IS NULL THEN 'added'
    WHEN c.show_id IS NULL AND e.status = 'active' THEN 'missing'
    WHEN c.show_id IS NULL AND e.status = 'missing' THEN 'still_missing'
    WHEN c.show_id IS NULL THEN 'kept'
    WHEN e.status = 'removed' THEN CASE WHEN NOT fast AND c.filename <> e.filename THEN 'removed_renamed' ELSE 'kept' END
    WHEN e.status IN ('missing', 'expired') THEN 'updated'
    WHEN NOT fast AND (c.filename <> e.filename OR c.size_bytes <> e.file_size_bytes OR c.mtime <> e.file_mtime) THEN 'updated'
    ELSE 'kept' END AS action
  FROM (SELECT * FROM ranked WHERE r = 1) c FULL JOIN episodes e ON e.show_id = c.show_id AND e.identity_key = c.identity_key)"""
SCAN_VIEWS = ("episodes", "file_listing")


def _pass(t):
    return reconcile(t.file_listing, t.episodes, SCAN_NOW, id_salt="scan-1")


@REGISTRY.add(
    "reconcile_changes",
    f"""WITH {CLAIMS_SQL} SELECT show_id, identity_key, action, status_before,
  CASE WHEN action = 'missing' THEN 'missing' WHEN action = 'still_missing' THEN 'missing' WHEN action = 'removed_renamed' THEN 'removed' ELSE 'active' END AS status_after,
  CASE WHEN action IN ('missing', 'still_missing') OR (action = 'updated' AND fast) THEN old_name ELSE new_name END AS filename,
  CASE WHEN action = 'added' THEN NULL ELSE id END AS known_id
FROM verdict WHERE action <> 'kept'""",
    SCAN_VIEWS,
)
def _(t):
    known = F.when(F.col("action") != "added", F.col("episode_id")).alias("known_id")
    return _pass(t).changes.select(
        "show_id", "identity_key", "action", "status_before", "status_after", "filename", known
    )


@REGISTRY.add(
    "reconcile_counts",
    f"""WITH {CLAIMS_SQL}, f AS (SELECT show_id, COUNT(*) AS files_found FROM af GROUP BY show_id),
v AS (SELECT show_id, COUNT(*) FILTER (WHERE action = 'added') AS added, COUNT(*) FILTER (WHERE action = 'updated') AS updated,
  COUNT(*) FILTER (WHERE action IN ('missing', 'still_missing')) AS missing FROM verdict GROUP BY show_id)
SELECT show_id, COALESCE(files_found, 0) AS files_found, COALESCE(added, 0) AS added, COALESCE(updated, 0) AS updated,
  COALESCE(missing, 0) AS missing, CAST(0 AS BIGINT) AS removed FROM f FULL JOIN v USING (show_id)""",
    SCAN_VIEWS,
)
def _(t):
    return _pass(t).counters


@REGISTRY.add(
    "reconcile_snapshot",
    f"""WITH {CLAIMS_SQL} SELECT v.show_id, v.identity_key,
  CASE WHEN v.action = 'added' OR (v.seen AND NOT v.fast AND (v.status_before <> 'removed' OR v.action = 'removed_renamed')) THEN v.new_name ELSE v.old_name END AS filename,
  CASE WHEN v.action = 'added' THEN 'active' WHEN v.action = 'missing' THEN 'missing'
    WHEN v.seen AND v.status_before IN ('missing', 'expired') THEN 'active' ELSE v.status_before END AS status,
  CASE WHEN v.action IN ('added', 'missing', 'updated', 'removed_renamed') THEN {SCAN_SQL} ELSE e.updated_at END AS updated_at,
  CASE WHEN v.action = 'missing' THEN {SCAN_SQL} WHEN v.seen AND v.status_before IN ('missing', 'expired') THEN NULL ELSE e.missing_since END AS missing_since,
  CASE WHEN v.seen AND v.status_before IN ('missing', 'expired') THEN NULL ELSE e.removed_at END AS removed_at,
  CASE WHEN v.action = 'added' OR (v.seen AND NOT v.fast AND v.status_before <> 'removed') THEN v.size_bytes ELSE v.file_size_bytes END AS file_size_bytes
FROM verdict v LEFT JOIN episodes e ON e.id = v.id""",
    SCAN_VIEWS,
)
def _(t):
    return _pass(t).episodes.select(
        "show_id", "identity_key", "filename", "status", "updated_at", "missing_since", "removed_at", "file_size_bytes"
    )


@REGISTRY.add(
    "duplicate_audio",
    f"WITH {CLAIMS_SQL} SELECT show_id, identity_key, filename, claimed_by FROM ranked WHERE r > 1",
    SCAN_VIEWS,
)
def _(t):
    from medialog.functions.text import audio_type
    from medialog.operators.reconcile import claim_identities, fast_match

    files = conform(t.file_listing, LISTING).withColumn("mime_type", audio_type(F.col("filename"))).where("mime_type IS NOT NULL")
    matched = fast_match(files, t.episodes).where("identity_key IS NOT NULL")
    copies = duplicate_files(matched, claim_identities(matched, t.episodes))
    return copies.select("show_id", "identity_key", "filename", "claimed_by")


@REGISTRY.add(
    "missing_episodes",
    f"""SELECT id, show_id, filename, status FROM episodes e WHERE {LIVE} AND NOT EXISTS (
  SELECT 1 FROM file_listing f WHERE f.show_id = e.show_id AND f.identity_key = e.identity_key)""",
    SCAN_VIEWS,
)
def _(t):
    seen = t.file_listing.select("show_id", "identity_key")
    return catalogue.unseen(t.episodes, seen).select("id", "show_id", "filename", "status")


@REGISTRY.add(
    "scan_pass_diagnostics",
    f"""WITH {CLAIMS_SQL} SELECT show_id, 'warning' AS level, 'unsupported' AS code, filename AS file FROM file_listing WHERE {EXT_SQL} = '.wma'
UNION ALL SELECT show_id, 'warning', 'duplicate', filename FROM ranked WHERE r > 1
UNION ALL SELECT show_id, 'warning', 'gone', old_name FROM verdict WHERE action = 'missing'
UNION ALL SELECT show_id, 'warning', 'returned', CASE WHEN fast THEN old_name ELSE new_name END FROM verdict WHERE seen AND status_before = 'expired'""",
    SCAN_VIEWS,
)
def _(t):
    # Several results come from one pass: its verdicts are written once.
    path = workspace(t.spark, "verdicts")
    done = _pass(t)
    done.rows.write.parquet(path)
    done = done.with_rows(t.spark.read.parquet(path))
    return done.diagnostics.select("show_id", "level", "code", "file")


FOLDERS_SQL = """fo AS (SELECT slug FROM shows WHERE CAST(REPLACE(id, 'show-', '') AS INT) % 9 <> 4
  UNION ALL SELECT CONCAT('fresh-', CAST(p_partkey AS STRING)) FROM part WHERE p_partkey % 40 = 1
  UNION ALL SELECT CONCAT('bad name ', CAST(p_partkey AS STRING)) FROM part WHERE p_partkey % 60 = 2
  UNION ALL SELECT CONCAT('.hidden', CAST(p_partkey AS STRING)) FROM part WHERE p_partkey % 60 = 3),
to_ AS (SELECT CONCAT('fresh-', CAST(p_partkey AS STRING)) AS slug FROM part WHERE p_partkey % 80 = 41)"""


@REGISTRY.add(
    "discover_shows",
    f"""WITH {FOLDERS_SQL} SELECT COALESCE(f.slug, s.slug) AS slug, s.id AS show_id, CASE
  WHEN f.slug LIKE 'bad%' THEN 'skipped' WHEN f.slug IS NOT NULL AND s.id IS NULL AND f.slug IN (SELECT slug FROM to_) THEN 'ignored'
  WHEN f.slug IS NOT NULL AND s.id IS NULL THEN 'new' WHEN f.slug IS NOT NULL AND s.status = 'folder_missing' THEN 'returned'
  WHEN f.slug IS NOT NULL THEN 'present' WHEN s.status = 'folder_missing' THEN 'still_missing' ELSE 'vanished' END AS verdict
FROM (SELECT * FROM fo WHERE slug NOT LIKE '.%') f FULL JOIN shows s ON s.slug = f.slug""",
    ("shows",),
)
def _(t):
    key = F.col("p_partkey")

    def folders(rule, pattern):
        return t.part.where(rule).select(F.format_string(pattern, key).alias("slug"))

    kept = t.shows.where(F.replace("id", F.lit("show-"), F.lit("")).cast("int") % 9 != 4).select("slug")
    listed = (
        kept.unionByName(folders(key % 40 == 1, "fresh-%d"))
        .unionByName(folders(key % 60 == 2, "bad name %d"))
        .unionByName(folders(key % 60 == 3, ".hidden%d"))
    )
    return discover.discover(listed, t.shows, folders(key % 80 == 41, "fresh-%d"))


# --- life cycle


@REGISTRY.add(
    "grace_sweep",
    f"""SELECT id, show_id, CASE WHEN st THEN 'expired' ELSE status END AS status, missing_since,
  CASE WHEN st THEN {NOW_SQL} ELSE removed_at END AS removed_at, CASE WHEN st THEN {NOW_SQL} ELSE updated_at END AS updated_at
FROM (SELECT *, status = 'missing' AND missing_since <= TIMESTAMP '2024-01-11 12:00:00' AS st FROM episodes)""",
    ("episodes",),
)
def _(t):
    swept = lifecycle.sweep_missing(t.episodes, NOW, 19 * 86400)
    return swept.select("id", "show_id", "status", "missing_since", "removed_at", "updated_at")


@REGISTRY.add(
    "apply_decisions",
    f"""WITH d AS (SELECT CONCAT('ep-', CAST(p_partkey AS STRING)) AS id, CASE WHEN p_partkey % 20 = 5 THEN 'restore' ELSE 'remove' END AS decision
  FROM part WHERE p_partkey % 5 = 0)
SELECT e.id, CASE d.decision WHEN 'remove' THEN 'removed' WHEN 'restore' THEN 'active' ELSE status END AS status,
  CASE d.decision WHEN 'remove' THEN {NOW_SQL} WHEN 'restore' THEN NULL ELSE removed_at END AS removed_at,
  CASE WHEN d.id IS NULL THEN missing_since END AS missing_since, CASE WHEN d.id IS NULL THEN updated_at ELSE {NOW_SQL} END AS updated_at
FROM episodes e LEFT JOIN d ON d.id = e.id""",
    ("episodes",),
)
def _(t):
    key = F.col("p_partkey")
    ids = F.format_string("ep-%d", key).alias("id")
    first = t.part.where(key % 5 == 0).select(ids, F.lit("remove").alias("decision"), F.lit(1).alias("decided_at"))
    # A later decision overrules the first.
    second = t.part.where(key % 20 == 5).select(ids, F.lit("restore").alias("decision"), F.lit(2).alias("decided_at"))
    out = lifecycle.apply_decisions(t.episodes, first.unionByName(second), NOW)
    return out.select("id", "status", "removed_at", "missing_since", "updated_at")


REBUILT = "s.status <> 'folder_missing' AND CAST(REPLACE(s.id, 'show-', '') AS INT) % 3 = 0"


@REGISTRY.add(
    "rebuild_counts",
    f"""WITH ch AS (SELECT s.id AS show_id FROM shows s WHERE {REBUILT}),
b AS (SELECT show_id, COUNT(*) AS forgotten, COUNT(*) FILTER (WHERE {LIVE} AND pub_date <= {SCAN_SQL}) AS in_feed_before FROM episodes GROUP BY show_id),
a AS (SELECT show_id, COUNT(DISTINCT identity_key) AS imported FROM file_listing WHERE {AUDIO_SQL} GROUP BY show_id)
SELECT ch.show_id, COALESCE(forgotten, 0) AS forgotten, COALESCE(in_feed_before, 0) AS in_feed_before,
  COALESCE(imported, 0) AS imported, COALESCE(imported, 0) AS in_feed_after FROM ch LEFT JOIN b USING (show_id) LEFT JOIN a USING (show_id)""",
    ("shows", "episodes", "file_listing"),
)
def _(t):
    chosen = t.shows.where(F.replace("id", F.lit("show-"), F.lit("")).cast("int") % 3 == 0).select(F.col("id").alias("show_id"))
    return lifecycle.rebuild(t.file_listing, t.episodes, t.shows, chosen, SCAN_NOW, "rebuild-1")[1]


@REGISTRY.add(
    "cascade_remaining",
    """WITH gone AS (SELECT id, slug FROM shows WHERE CAST(REPLACE(id, 'show-', '') AS INT) % 4 = 1)
SELECT 'shows' AS table_name, COUNT(*) AS n FROM shows WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'episodes', COUNT(*) FROM episodes WHERE show_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'scan_log', COUNT(*) FROM scan_log WHERE show_id IS NULL OR show_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'media_access', COUNT(*) FROM media_access WHERE show_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'removed_folders', COUNT(*) FROM gone""",
    ("shows", "episodes", "scan_log", "media_access"),
)
def _(t):
    ids = t.shows.where(F.replace("id", F.lit("show-"), F.lit("")).cast("int") % 4 == 1).select(F.col("id").alias("show_id"))
    tables = {name: getattr(t, name) for name in ("shows", "episodes", "scan_log", "media_access")}
    # One show had been removed before; its mark is renewed, not doubled.
    tables["removed_folders"] = t.shows.where("id = 'show-1'").select("slug", F.lit(datetime(2020, 1, 1)).cast("timestamp").alias("removed_at"))
    left = lifecycle.remove_shows(tables, ids, NOW)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@REGISTRY.add(
    "art_changes",
    f"""WITH i AS (SELECT show_id, {STEM_SQL} AS stem, filename, mtime, ROW_NUMBER() OVER (PARTITION BY show_id, {STEM_SQL}
  ORDER BY CASE {EXT_SQL} WHEN '.jpg' THEN 0 WHEN '.jpeg' THEN 1 WHEN '.png' THEN 2 ELSE 3 END, filename) AS r
  FROM file_listing WHERE {IMAGE_SQL}),
w AS (SELECT e.id, e.art_source AS old_source, e.art_filename AS old_filename, e.art_etag AS old_etag, i.filename AS side, i.mtime
  FROM episodes e LEFT JOIN i ON i.r = 1 AND i.show_id = e.show_id AND i.stem = lower(regexp_replace(e.filename, '^(.+)\\.[^.]*$', '\\1'))
    AND EXISTS (SELECT 1 FROM file_listing f WHERE f.show_id = e.show_id AND f.filename = e.filename)
  WHERE e.status <> 'removed')
SELECT id, CASE WHEN side IS NOT NULL THEN 'sidecar' END AS art_source, side AS art_filename, side AS art_sidecar_name,
  md5(side) AS art_etag FROM w WHERE side IS NOT NULL OR old_source IS NOT NULL""",
    SCAN_VIEWS,
)
def _(t):
    from medialog.functions.text import image_type

    stored = t.file_listing.where(image_type(F.col("filename")).isNotNull()).select(
        "show_id", "filename", F.lit("sidecar").alias("source"), F.col("filename").alias("stored_name"),
        F.lit(1500).alias("width"), F.lit(1500).alias("height"), F.md5("filename").alias("etag"),
    )
    from medialog.operators.reconcile import conform as shaped
    from medialog.schemas import EPISODES

    episodes = shaped(t.episodes, EPISODES)
    wanted = artwork.choose_art(episodes, artwork.sidecar_art(t.file_listing), stored)
    return artwork.art_changes(episodes, wanted).select("id", "art_source", "art_filename", "art_sidecar_name", "art_etag")


@REGISTRY.add(
    "fill_defaults",
    f"""SELECT id, CASE WHEN trim(author_name) = '' THEN 'House' ELSE author_name END AS author_name,
  CASE WHEN trim(author_email) = '' THEN 'house@example.com' ELSE author_email END AS author_email,
  trim(author_name) = '' OR trim(author_email) = '' AS changed,
  CASE WHEN trim(author_name) = '' OR trim(author_email) = '' THEN {NOW_SQL} ELSE updated_at END AS updated_at FROM shows""",
    ("shows",),
)
def _(t):
    out = patches.fill_defaults(t.shows, "House", "house@example.com", NOW)
    return out.select("id", "author_name", "author_email", "changed", "updated_at")


@REGISTRY.add(
    "patch_episodes",
    f"""WITH p AS (SELECT CONCAT('ep-', CAST(p_partkey AS STRING)) AS id,
  CASE p_partkey % 4 WHEN 0 THEN ' New ' WHEN 1 THEN '  ' WHEN 2 THEN CONCAT(p_name, ' ', CAST(p_partkey AS STRING)) END AS title,
  CASE p_partkey % 7 WHEN 0 THEN 'x' WHEN 1 THEN '12' WHEN 2 THEN '' END AS season,
  CASE p_partkey % 5 WHEN 0 THEN 'Trailer' WHEN 1 THEN 'movie' END AS episode_type,
  CASE p_partkey % 3 WHEN 0 THEN 'inherit' WHEN 1 THEN 'yes' END AS explicit FROM part WHERE p_partkey % 2 = 0),
c AS (SELECT p.*, trim(title) = '' AS bad_title, season = 'x' AS bad_season, episode_type = 'movie' AS bad_type FROM p),
v AS (SELECT *, NOT (COALESCE(bad_title, FALSE) OR COALESCE(bad_season, FALSE) OR COALESCE(bad_type, FALSE)) AS valid FROM c)
SELECT e.id, CASE WHEN valid AND v.title IS NOT NULL THEN trim(v.title) ELSE e.title END AS title,
  CASE WHEN valid AND v.title IS NOT NULL THEN CASE WHEN trim(v.title) = e.tag_title THEN 0 ELSE 1 END ELSE e.title_is_custom END AS title_is_custom,
  CASE WHEN valid AND v.season IS NOT NULL THEN TRY_CAST(NULLIF(v.season, '') AS INT) ELSE e.season END AS season,
  CASE WHEN valid AND v.episode_type IS NOT NULL THEN lower(v.episode_type) ELSE e.episode_type END AS episode_type,
  CASE WHEN valid AND v.explicit IS NOT NULL THEN CASE WHEN v.explicit = 'yes' THEN 1 END ELSE e.explicit END AS explicit,
  CASE WHEN valid AND (v.title IS NOT NULL OR v.season IS NOT NULL OR v.episode_type IS NOT NULL OR v.explicit IS NOT NULL) THEN {NOW_SQL} ELSE e.updated_at END AS updated_at,
  COALESCE(NOT valid, FALSE) AS refused
FROM episodes e LEFT JOIN v ON v.id = e.id""",
    ("episodes",),
)
def _(t):
    edits = t.part.where("p_partkey % 2 = 0").selectExpr(
        "CONCAT('ep-', p_partkey) AS id",
        "CASE p_partkey % 4 WHEN 0 THEN ' New ' WHEN 1 THEN '  ' WHEN 2 THEN CONCAT(p_name, ' ', p_partkey) END AS title",
        "CASE p_partkey % 7 WHEN 0 THEN 'x' WHEN 1 THEN '12' WHEN 2 THEN '' END AS season",
        "CASE p_partkey % 5 WHEN 0 THEN 'Trailer' WHEN 1 THEN 'movie' END AS episode_type",
        "CASE p_partkey % 3 WHEN 0 THEN 'inherit' WHEN 1 THEN 'yes' END AS explicit",
    )
    out = patches.apply_patches(t.episodes, edits, patches.episode_rules("UTC"), NOW)
    return out.select(
        "id", "title", "title_is_custom", "season", "episode_type", "explicit", "updated_at",
        (F.size("errors") > 0).alias("refused"),
    )


@REGISTRY.add(
    "patch_shows",
    f"""WITH p AS (SELECT CONCAT('show-', CAST(s_suppkey AS STRING)) AS id,
  CASE s_suppkey % 3 WHEN 0 THEN 'me@example.com' WHEN 1 THEN 'not an email' END AS author_email,
  CASE s_suppkey % 5 WHEN 0 THEN 'EN-GB' WHEN 1 THEN '' END AS language,
  CASE s_suppkey % 4 WHEN 0 THEN 'Education' WHEN 1 THEN 'Tech' END AS category,
  CASE s_suppkey % 2 WHEN 0 THEN 'How To' END AS subcategory FROM supplier),
v AS (SELECT p.*, NOT (COALESCE(author_email = 'not an email', FALSE) OR COALESCE(category = 'Tech', FALSE)
  OR (subcategory IS NOT NULL AND COALESCE(category, '') <> 'Education')) AS valid FROM p)
SELECT s.id, CASE WHEN valid AND v.author_email IS NOT NULL THEN v.author_email ELSE s.author_email END AS author_email,
  CASE WHEN valid AND v.language IS NOT NULL THEN CASE WHEN v.language = '' THEN 'en' ELSE lower(v.language) END ELSE s.language END AS language,
  CASE WHEN valid AND v.category IS NOT NULL THEN v.category ELSE s.itunes_category END AS itunes_category,
  CASE WHEN valid AND v.subcategory IS NOT NULL THEN v.subcategory ELSE s.itunes_subcategory END AS itunes_subcategory,
  NOT valid AS refused FROM shows s JOIN v ON v.id = s.id""",
    ("shows",),
)
def _(t):
    edits = t.supplier.selectExpr(
        "CONCAT('show-', s_suppkey) AS id",
        "CASE s_suppkey % 3 WHEN 0 THEN 'me@example.com' WHEN 1 THEN 'not an email' END AS author_email",
        "CASE s_suppkey % 5 WHEN 0 THEN 'EN-GB' WHEN 1 THEN '' END AS language",
        "CASE s_suppkey % 4 WHEN 0 THEN 'Education' WHEN 1 THEN 'Tech' END AS category",
        "CASE s_suppkey % 2 WHEN 0 THEN 'How To' END AS subcategory",
    )
    out = patches.apply_patches(t.shows, edits, patches.show_rules(), NOW)
    return out.select(
        "id", "author_email", "language", "itunes_category", "itunes_subcategory", (F.size("errors") > 0).alias("refused")
    )


# --- settings and categories

BASE_SQL = r"""CASE WHEN regexp_matches({0}, '^(?i)https?://[^/]+') THEN
  lower(regexp_extract({0}, '^([A-Za-z]+)://([^/]+)(.*?)/*$', 1)) || '://' || lower(regexp_extract({0}, '^([A-Za-z]+)://([^/]+)(.*?)/*$', 2))
  || regexp_extract({0}, '^([A-Za-z]+)://([^/]+)(.*?)/*$', 3) END"""
WIDE_SQL = """w AS (SELECT instance_id, MAX(value) FILTER (WHERE key = 'public_base_url') AS base,
  MAX(value) FILTER (WHERE key = 'previous_public_base_url') AS prev, MAX(value) FILTER (WHERE key = 'previous_public_base_url_set_at') AS prev_at,
  MAX(value) FILTER (WHERE key = 'rescan_interval_seconds') AS rescan, MAX(value) FILTER (WHERE key = 'missing_grace_seconds') AS grace,
  MAX(value) FILTER (WHERE key = 'watcher_enabled') AS watcher, MAX(value) FILTER (WHERE key = 'default_author_name') AS author
  FROM settings GROUP BY instance_id)"""


@REGISTRY.add(
    "settings_typed",
    f"""WITH {WIDE_SQL} SELECT instance_id, {BASE_SQL.format('base')} AS public_base_url,
  CASE WHEN CAST(LEFT(prev_at, 19) AS TIMESTAMP) >= {NOW_SQL} - INTERVAL 60 DAY THEN {BASE_SQL.format('prev')} END AS previous_base_url,
  COALESCE(author, '') AS default_author_name,
  CAST(LEAST(21600, GREATEST(60, COALESCE(TRY_CAST(rescan AS BIGINT), 300))) AS BIGINT) AS rescan_interval_seconds,
  CAST(LEAST(2592000, GREATEST(60, COALESCE(TRY_CAST(grace AS BIGINT), 86400))) AS BIGINT) AS missing_grace_seconds,
  COALESCE(watcher IN ('1', 'true'), TRUE) AS watcher_enabled FROM w""",
    ("settings",),
)
def _(t):
    return settings.typed_settings(t.settings, NOW).select(
        "instance_id", "public_base_url", "previous_base_url", "default_author_name", "rescan_interval_seconds",
        "missing_grace_seconds", "watcher_enabled",
    )


@REGISTRY.add(
    "address_move",
    f"""WITH {WIDE_SQL}, b AS (SELECT instance_id, {BASE_SQL.format('base')} AS old FROM w),
p AS (SELECT CAST(c_custkey AS STRING) AS instance_id, CASE WHEN c_custkey % 3 = 0 THEN CONCAT('https://pod', CAST(c_custkey AS STRING), '.example.com/base')
  ELSE 'https://new.example.com' END AS new FROM customer WHERE c_custkey % 2 = 0)
SELECT instance_id, 'previous_public_base_url' AS key, old AS value FROM b JOIN p USING (instance_id) WHERE old <> new
UNION ALL SELECT instance_id, 'previous_public_base_url_set_at', '2024-01-30T12:00:00.000Z' FROM b JOIN p USING (instance_id) WHERE old <> new""",
    ("settings",),
)
def _(t):
    patch = t.customer.where("c_custkey % 2 = 0").selectExpr(
        "CAST(c_custkey AS STRING) AS instance_id",
        "'public_base_url' AS key",
        "CASE WHEN c_custkey % 3 = 0 THEN CONCAT('https://pod', c_custkey, '.example.com/base') ELSE 'https://new.example.com' END AS value",
    )
    return settings.address_moves(t.settings, patch, NOW)


@REGISTRY.add(
    "settings_upsert",
    """SELECT instance_id, key, CASE WHEN key = 'watcher_enabled' THEN '0' ELSE value END AS value FROM settings
WHERE NOT (key = 'default_author_name' OR (key = 'watcher_enabled' AND FALSE)) AND NOT (key = 'watcher_enabled')
UNION ALL SELECT CAST(c_custkey AS STRING), 'watcher_enabled', '0' FROM customer""",
    ("settings",),
)
def _(t):
    ids = t.customer.selectExpr("CAST(c_custkey AS STRING) AS instance_id")
    patch = ids.selectExpr("instance_id", "'watcher_enabled' AS key", "'0' AS value").unionByName(
        ids.selectExpr("instance_id", "'default_author_name' AS key", "CAST(NULL AS STRING) AS value")
    )
    return settings.upsert(t.settings, patch)


RAW_CATEGORY = """CASE p_partkey % 12 WHEN 0 THEN 'arts' WHEN 1 THEN 'Arts > Books' WHEN 2 THEN 'self improvement' WHEN 3 THEN 'TV and Film'
  WHEN 4 THEN 'Arts/Podcraft' WHEN 5 THEN 'Nonsense' WHEN 6 THEN 'Podcasts | Fitness' WHEN 7 THEN 'Society & Culture → Philosophy'
  WHEN 8 THEN 'Comedy - Stand-Up' WHEN 9 THEN '' WHEN 10 THEN 'Éducation' ELSE NULL END"""


@REGISTRY.add(
    "match_category",
    f"""SELECT p_partkey, {RAW_CATEGORY} AS raw, CASE p_partkey % 12 WHEN 0 THEN 'Arts' WHEN 1 THEN 'Arts' WHEN 2 THEN 'Education' WHEN 3 THEN 'TV & Film'
  WHEN 4 THEN 'Arts' WHEN 6 THEN 'Health & Fitness' WHEN 7 THEN 'Society & Culture' WHEN 8 THEN 'Comedy' END AS category,
  CASE p_partkey % 12 WHEN 1 THEN 'Books' WHEN 2 THEN 'Self-Improvement' WHEN 6 THEN 'Fitness' WHEN 7 THEN 'Philosophy' WHEN 8 THEN 'Stand-Up' END AS subcategory
FROM part""",
)
def _(t):
    raw = t.part.selectExpr("p_partkey", f"{RAW_CATEGORY} AS raw")
    return categories.match_category(raw, "raw")
