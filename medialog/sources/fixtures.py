"""Domain tables derived from the driver tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from medialog.session import configure

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Known schemas save the inference pass. Zone-less instants are UTC and are read as such.
EXPLICIT = {
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP, o_orderpriority STRING",
}

VIEWS: dict[str, str] = {}

VIEWS["shows"] = """
SELECT CONCAT('show-', CAST(s_suppkey AS STRING)) AS id,
       LOWER(REPLACE(s_name, '#', '-')) AS slug,
       s_name AS title,
       CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE CONCAT('About ', s_name) END AS description,
       CASE WHEN s_suppkey % 7 = 0 THEN ' ' ELSE 'Owner' END AS author_name,
       CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE CONCAT('owner', CAST(s_suppkey AS STRING), '@example.com') END AS author_email,
       CASE WHEN s_suppkey % 6 = 0 THEN 'en-gb' ELSE 'en' END AS language,
       CASE WHEN s_suppkey % 11 = 0 THEN 'Tech' WHEN s_suppkey % 11 = 1 THEN 'Arts' ELSE 'Technology' END AS itunes_category,
       CASE WHEN s_suppkey % 11 = 1 THEN 'Books' END AS itunes_subcategory,
       CASE WHEN s_suppkey % 6 = 1 THEN 'serial' ELSE 'episodic' END AS itunes_type,
       CAST(s_suppkey % 2 AS INT) AS explicit,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'cover.webp' ELSE 'cover.jpg' END AS cover_filename,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 4 = 1 THEN 'webp' ELSE 'jpeg' END AS cover_format,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(1000 + (s_suppkey % 9) * 250 AS INT) END AS cover_width,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL WHEN s_suppkey % 10 = 3 THEN 1400 ELSE CAST(1000 + (s_suppkey % 9) * 250 AS INT) END AS cover_height,
       CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE TIMESTAMP '2024-01-04 00:00:00' END AS cover_mtime,
       CONCAT('tok ', CAST(s_suppkey AS STRING)) AS feed_token,
       CASE WHEN s_suppkey % 13 = 0 THEN 'folder_missing' ELSE 'active' END AS status,
       CASE WHEN s_suppkey % 17 = 0 THEN 'blocked' ELSE 'allowed' END AS directory_listing,
       TIMESTAMP '2024-01-01 00:00:00' AS created_at,
       TIMESTAMP '2024-01-05 00:00:00' AS updated_at
FROM supplier"""

VIEWS["episodes"] = """
SELECT CONCAT('ep-', CAST(p_partkey AS STRING)) AS id,
       CONCAT('show-', CAST(p_partkey % (SELECT COUNT(*) FROM supplier) AS STRING)) AS show_id,
       CONCAT(REPLACE(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING), '.mp3') AS filename,
       CONCAT('idk-', CAST(p_partkey AS STRING)) AS identity_key,
       CONCAT(p_name, ' ', CAST(p_partkey AS STRING)) AS title,
       CASE WHEN p_partkey % 6 = 0 THEN 1 ELSE 0 END AS title_is_custom,
       CONCAT(p_name, ' ', CAST(p_partkey AS STRING)) AS tag_title,
       CASE WHEN p_partkey % 9 = 0 THEN '' ELSE CONCAT('About <', p_name, '> & more') END AS description,
       CASE WHEN p_partkey % 12 = 0 THEN CAST(p_partkey % 5 AS INT) END AS season,
       CASE WHEN p_partkey % 14 = 0 THEN CAST(p_partkey % 50 AS INT) END AS episode_number,
       CASE p_partkey % 15 WHEN 1 THEN 'trailer' WHEN 2 THEN 'bonus' ELSE 'full' END AS episode_type,
       CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE CAST(p_size * 60 AS INT) END AS duration_seconds,
       CASE WHEN p_partkey % 8 = 0 THEN NULL ELSE 128 END AS bitrate_kbps,
       CASE WHEN p_partkey % 10 = 0 THEN 1 WHEN p_partkey % 10 = 1 THEN 0 ELSE NULL END AS explicit,
       CAST(p_size AS BIGINT) * 1048576 AS file_size_bytes,
       CASE WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2024-01-03 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS file_mtime,
       'audio/mpeg' AS mime_type,
       CASE WHEN p_partkey % 20 = 3 THEN 'missing' WHEN p_partkey % 20 = 5 THEN 'removed' WHEN p_partkey % 20 = 7 THEN 'expired' ELSE 'active' END AS status,
       TIMESTAMP '2024-01-01 00:00:00' + (p_partkey % 40) * INTERVAL '1' DAY AS pub_date,
       0 AS pub_date_is_custom,
       TIMESTAMP '2023-12-01 00:00:00' + (p_partkey % 90) * INTERVAL '1' HOUR AS created_at,
       CASE WHEN p_partkey % 20 IN (3, 7) THEN TIMESTAMP '2024-01-10 00:00:00' + (p_partkey % 72) * INTERVAL '1' HOUR END AS missing_since,
       CASE WHEN p_partkey % 20 IN (5, 7) THEN TIMESTAMP '2024-01-15 00:00:00' + (p_partkey % 72) * INTERVAL '1' HOUR END AS removed_at,
       CASE WHEN p_partkey % 13 = 0 THEN CONCAT('ep-', CAST(p_partkey AS STRING), '.jpg') END AS art_filename,
       CASE WHEN p_partkey % 13 = 0 THEN 'sidecar' END AS art_source,
       CASE WHEN p_partkey % 13 = 0 THEN CONCAT('e', CAST(p_partkey AS STRING)) END AS art_etag,
       TIMESTAMP '2024-01-20 00:00:00' AS updated_at
FROM part"""

VIEWS["media_access"] = """
WITH b AS (
  SELECT event_id, ts, user_id, event_type,
         CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
         (event_id * 31) % (SELECT COUNT(*) FROM part) AS pk
  FROM events),
j AS (
  SELECT b.*, CAST(p.p_size AS BIGINT) * 1048576 AS total,
         CASE event_type WHEN 'view' THEN 'download' WHEN 'click' THEN 'stream'
              WHEN 'signup' THEN 'feed' WHEN 'purchase' THEN 'cover'
              ELSE CASE WHEN event_id % 2 = 0 THEN 'download' ELSE 'stream' END END AS kind,
         CASE event_type WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 404 WHEN 1 THEN 416 ELSE 500 END
              WHEN 'click' THEN 206
              WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 304 ELSE 200 END
              ELSE 200 END AS status_code
  FROM b JOIN part p ON p.p_partkey = b.pk)
SELECT event_id AS id,
       CASE WHEN kind IN ('feed', 'cover') THEN NULL ELSE CONCAT('ep-', CAST(pk AS STRING)) END AS episode_id,
       CONCAT('show-', CAST(pk % (SELECT COUNT(*) FROM supplier) AS STRING)) AS show_id,
       ts AS requested_at, kind, status_code,
       CASE WHEN status_code >= 400 OR (kind = 'download' AND k < 10) THEN NULL
            WHEN status_code = 304 THEN CAST(0 AS BIGINT)
            WHEN kind = 'stream' OR (kind = 'download' AND k < 20) THEN CAST(FLOOR(CAST(total AS DOUBLE) * k / 100) AS BIGINT)
            ELSE total END AS bytes_sent,
       CASE WHEN kind = 'feed' THEN NULL ELSE total END AS total_bytes,
       CASE WHEN kind = 'stream' THEN CONCAT('bytes=', CAST(k AS STRING), '-') END AS range_header,
       CASE user_id % 9 WHEN 0 THEN 'Pocket Casts' WHEN 1 THEN 'Overcast' WHEN 2 THEN 'Apple Podcasts'
            WHEN 3 THEN 'AntennaPod' WHEN 4 THEN 'Spotify' WHEN 5 THEN 'Browser' WHEN 6 THEN 'Command line'
            WHEN 7 THEN 'Other' ELSE NULL END AS client,
       CASE WHEN status_code >= 400 THEN CONCAT('could not be served (HTTP ', CAST(status_code AS STRING), ').') END AS error
FROM j"""

VIEWS["raw_request"] = """
SELECT event_id AS request_id, ts AS requested_at, user_id,
       CONCAT('show-', CAST(event_id % 10 AS STRING)) AS show_id,
       CASE WHEN event_type = 'signup' THEN NULL ELSE CONCAT('ep-', CAST(event_id AS STRING)) END AS episode_id,
       CASE event_type WHEN 'signup' THEN 'feed' WHEN 'purchase' THEN 'cover' ELSE 'media' END AS route,
       CASE WHEN event_type = 'signup' THEN NULL ELSE CONCAT('a', CAST(event_id % 7 AS STRING), '.mp3') END AS file_name,
       CASE user_id % 16 WHEN 0 THEN 'Pocket Casts/7.5 (iPhone; iOS 18.2)' WHEN 1 THEN 'Overcast/2024 (+http://overcast.fm/)'
            WHEN 2 THEN 'AntennaPod/3.4.0' WHEN 3 THEN 'Podcasts/1580.3 (iPhone; iOS 18.2)' WHEN 4 THEN 'AppleCoreMedia/1.0.0 (iPhone)'
            WHEN 5 THEN 'Spotify/8.9 iOS' WHEN 6 THEN 'SomeNewPodcastApp/1.0' WHEN 7 THEN 'curl/8.4.0'
            WHEN 8 THEN 'Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 Chrome/120' WHEN 9 THEN ''
            WHEN 10 THEN NULL WHEN 11 THEN 'Castro 2023' WHEN 12 THEN 'PodcastAddict/v5' WHEN 13 THEN 'VLC/3.0.18'
            WHEN 14 THEN 'okhttp (Linux; Android 14)' ELSE 'iTunes/12.9' END AS user_agent,
       CASE event_id % 4 WHEN 0 THEN CONCAT('/feeds/show-', CAST(event_id % 10 AS STRING), '/tok', CAST(user_id AS STRING), '.xml')
            WHEN 1 THEN CONCAT('/feeds/show-', CAST(event_id % 10 AS STRING), '/tok', CAST(user_id AS STRING), '.xml?x=1')
            WHEN 2 THEN CONCAT('/media/show-', CAST(event_id % 10 AS STRING), '/tok', CAST(user_id AS STRING), '/ep-', CAST(event_id AS STRING), '/a.mp3')
            ELSE '/health' END AS url,
       CASE WHEN event_type = 'click' THEN CONCAT('bytes=', CAST(event_id AS STRING), '-', REPEAT('9', 90)) END AS range_header,
       CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 304
            WHEN event_type = 'click' THEN 206
            WHEN event_type = 'error' THEN CASE event_id % 3 WHEN 0 THEN 404 WHEN 1 THEN 416 ELSE 500 END ELSE 200 END AS status_code,
       event_id % 19 = 0 AS aborted,
       CASE WHEN event_id % 11 = 0 THEN event_id * 3 END AS stated_bytes,
       CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id * 7 END AS content_length,
       event_id * 9 AS total_bytes,
       CASE WHEN event_type = 'error' AND event_id % 23 = 0 THEN 'explained' END AS error,
       event_id % 50 = 0 AS is_owner
FROM events"""

VIEWS["file_listing"] = """
WITH base AS (
  SELECT p_partkey AS pk, CONCAT('show-', CAST(p_partkey % (SELECT COUNT(*) FROM supplier) AS STRING)) AS show_id,
         CONCAT(REPLACE(p_name, ' ', '-'), '-', CAST(p_partkey AS STRING), '.mp3') AS fn,
         CAST(p_size AS BIGINT) * 1048576 AS sz
  FROM part)
SELECT show_id, CASE WHEN pk % 30 = 4 THEN CONCAT('renamed-', fn) ELSE fn END AS filename,
       CASE WHEN pk % 35 = 6 THEN sz + 1 ELSE sz END AS size_bytes,
       CASE WHEN pk % 35 = 6 THEN CONCAT('idk-new-', CAST(pk AS STRING)) ELSE CONCAT('idk-', CAST(pk AS STRING)) END AS identity_key,
       TIMESTAMP '2024-02-01 00:00:00' AS mtime
FROM base WHERE pk % 25 <> 2 AND NOT (pk % 20 IN (3, 7) AND pk % 40 IN (3, 7))
UNION ALL
SELECT show_id, CONCAT('copy-of-', fn), sz, CONCAT('idk-', CAST(pk AS STRING)), TIMESTAMP '2024-02-01 00:00:00' FROM base WHERE pk % 50 = 9
UNION ALL
SELECT show_id, CONCAT('clip-', CAST(pk AS STRING), '.wma'), sz, CONCAT('idk-wma-', CAST(pk AS STRING)), TIMESTAMP '2024-02-01 00:00:00' FROM base WHERE pk % 100 = 11
UNION ALL
SELECT show_id, REPLACE(fn, '.mp3', '.JPG'), 1000, NULL, TIMESTAMP '2024-02-01 00:00:00' FROM base WHERE pk % 9 = 0
UNION ALL
SELECT show_id, REPLACE(fn, '.mp3', '.png'), 1000, NULL, TIMESTAMP '2024-02-01 00:00:00' FROM base WHERE pk % 18 = 0
UNION ALL
SELECT show_id, CASE WHEN pk % 3 = 0 THEN 'Folder.jpg' WHEN pk % 3 = 1 THEN 'COVER.png' ELSE 'notes.txt' END, 2000, NULL,
       TIMESTAMP '2024-02-01 00:00:00' FROM base WHERE pk < (SELECT COUNT(*) FROM supplier)"""

VIEWS["scan_log"] = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE CONCAT('show-', CAST(o_custkey % (SELECT COUNT(*) FROM supplier) AS STRING)) END AS show_id,
       o_orderdate AS started_at,
       CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL '30' SECOND END AS finished_at,
       CASE SUBSTRING(o_orderpriority, 1, 1) WHEN '1' THEN 'watcher' WHEN '2' THEN 'scheduled' WHEN '3' THEN 'manual' WHEN '4' THEN 'startup' ELSE 'upload' END AS trigger,
       CAST(o_orderkey % 7 AS INT) AS files_found,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 3 AS INT) ELSE 0 END AS added,
       CAST(o_orderkey % 2 AS INT) AS updated, 0 AS missing, 0 AS removed,
       CASE WHEN o_orderkey % 6 = 0 THEN CONCAT('[{"file":"f', CAST(o_orderkey AS STRING), '.mp3","message":"Permission denied","code":"EACCES"}]') END AS errors_json,
       CASE WHEN o_orderkey % 5 = 0 THEN '[{"file":"a.wma","message":"ignored"},{"file":"b.mp3","message":"missing"}]' WHEN o_orderkey % 77 = 1 THEN 'not json' WHEN o_orderkey % 77 = 2 THEN '{"file":"x"}' END AS warnings_json
FROM orders"""

VIEWS["login_attempts"] = """
SELECT event_id AS id, CONCAT('user-', CAST(user_id % 5 AS STRING)) AS username, ts AS attempted_at,
       CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS succeeded
FROM events WHERE event_type IN ('signup', 'error')"""

# Key/value settings of one instance per customer.
VIEWS["settings"] = """
SELECT CAST(c_custkey AS STRING) AS instance_id, 'public_base_url' AS key,
       CASE WHEN c_custkey % 4 = 0 THEN 'ftp://x' ELSE CONCAT('HTTPS://Pod', CAST(c_custkey AS STRING), '.example.com/base/') END AS value
FROM customer WHERE c_custkey % 9 <> 0
UNION ALL
SELECT CAST(c_custkey AS STRING), 'rescan_interval_seconds', CAST(c_custkey * 7 AS STRING) FROM customer WHERE c_custkey % 3 = 0
UNION ALL
SELECT CAST(c_custkey AS STRING), 'missing_grace_seconds', CASE WHEN c_custkey % 10 = 0 THEN 'soon' ELSE CAST(c_custkey * 2000 AS STRING) END FROM customer WHERE c_custkey % 2 = 0
UNION ALL
SELECT CAST(c_custkey AS STRING), 'watcher_enabled', CASE WHEN c_custkey % 5 = 0 THEN '0' WHEN c_custkey % 5 = 1 THEN 'true' ELSE '1' END FROM customer WHERE c_custkey % 7 = 0
UNION ALL
SELECT CAST(c_custkey AS STRING), 'default_author_name', c_name FROM customer WHERE c_custkey % 6 = 0
UNION ALL
SELECT CAST(c_custkey AS STRING), 'session_secret', 'hidden' FROM customer
UNION ALL
SELECT CAST(c_custkey AS STRING), 'previous_public_base_url', 'http://old.example.com/' FROM customer WHERE c_custkey % 8 = 1
UNION ALL
SELECT CAST(c_custkey AS STRING), 'previous_public_base_url_set_at',
       CASE WHEN c_custkey % 3 = 0 THEN '2023-06-01T00:00:00.000Z' ELSE '2024-01-01T00:00:00.000Z' END FROM customer WHERE c_custkey % 16 = 1"""


def _prefix(sf_dir: str) -> str:
    return "medialog_" + hashlib.md5(sf_dir.encode()).hexdigest()[:8]


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(EXPLICIT[name]) if name in EXPLICIT else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table (a key of VIEWS) or a driver table, over the files of ``sf_dir``."""
    configure(spark)
    if name not in VIEWS:
        return driver_table(spark, sf_dir, name)
    text = VIEWS[name]
    ctes = []
    for source in DRIVER_TABLES:
        if f"FROM {source}" in text or f"JOIN {source}" in text:
            view = f"{_prefix(sf_dir)}_{source}"
            driver_table(spark, sf_dir, source).createOrReplaceTempView(view)
            ctes.append(f"{source} AS (SELECT * FROM {view})")
    return spark.sql(f"WITH {', '.join(ctes)}, {name} AS ({text}) SELECT * FROM {name}")


def streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table that depends on events alone, as a file stream over them."""
    configure(spark)
    events = spark.readStream.schema(EXPLICIT["events"]).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    view = f"{_prefix(sf_dir)}_event_stream"
    events.createOrReplaceTempView(view)
    return spark.sql(f"WITH events AS (SELECT * FROM {view}) {VIEWS[name]}")


def oracle(body: str, *views: str) -> str:
    """DuckDB text: the named domain tables as common table expressions, then ``body``.

    A body that starts with ``WITH`` continues the list.
    """
    ctes = ", ".join(f"{v} AS ({VIEWS[v]})" for v in views)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}" if ctes else body
    return f"WITH {ctes} {body}" if ctes else body
