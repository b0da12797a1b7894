"""Registered queries over text documents: identities, show configuration, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from medialog.registry.core import REGISTRY
from medialog.session import workspace
from medialog.sources.listing import content_identity
from medialog.sources.show_config import parse_show_config, settings_json, show_config_json
from medialog.sources.store import Store


@REGISTRY.add(
    "content_identity",
    """SELECT doc_id, sha256(text || CAST(strlen(text) AS VARCHAR)) AS identity_key FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", content_identity(F.encode("text", "UTF-8")).alias("identity_key"))


# Hand-written files of every quality, one per supplier.
CONFIG_TEXT = """CASE s_suppkey % 6
  WHEN 0 THEN CONCAT('{"title": " ', s_name, ' ", "author": "A", "explicit": true, "itunes_type": "Serial", "category": "Arts/Books"}')
  WHEN 1 THEN CONCAT('{"title": "', s_name, '", "authorName": "B", "author": "A", "explicit": "true", "itunesType": "odd", "language": "EN-GB"}')
  WHEN 2 THEN '{"title": "   ", "author_email": "x@y.z", "email": "no", "explicit": false, "category": "nothing", "subcategory": "Kept"}'
  WHEN 3 THEN '{broken' WHEN 4 THEN '[1, 2]' ELSE '{"description": "D", "category": "history"}' END"""


@REGISTRY.add(
    "show_config_import",
    """SELECT LOWER(REPLACE(s_name, '#', '-')) AS slug, s_suppkey % 6 NOT IN (3, 4) AS found,
  CASE WHEN s_suppkey % 6 < 2 THEN s_name END AS title, CASE WHEN s_suppkey % 6 = 5 THEN 'D' END AS description,
  CASE s_suppkey % 6 WHEN 0 THEN 'A' WHEN 1 THEN 'B' END AS author_name, CASE WHEN s_suppkey % 6 = 2 THEN 'x@y.z' END AS author_email,
  CASE WHEN s_suppkey % 6 = 1 THEN 'en-gb' END AS language,
  CASE s_suppkey % 6 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS explicit,
  CASE WHEN s_suppkey % 6 = 0 THEN 'serial' END AS itunes_type,
  CASE s_suppkey % 6 WHEN 0 THEN 'Arts' WHEN 5 THEN 'History' END AS category,
  CASE s_suppkey % 6 WHEN 0 THEN 'Books' WHEN 2 THEN 'Kept' END AS subcategory FROM supplier""",
)
def _(t):
    texts = t.supplier.selectExpr("LOWER(REPLACE(s_name, '#', '-')) AS slug", f"{CONFIG_TEXT} AS text")
    return parse_show_config(texts)


@REGISTRY.add(
    "show_config_export",
    """SELECT slug, title, description, author_name, author_email, language, itunes_category AS category,
  itunes_subcategory AS subcategory, CASE WHEN explicit = 1 THEN 'true' ELSE 'false' END AS explicit, itunes_type FROM shows""",
    ("shows",),
)
def _(t):
    fields = "title description author_name author_email language category subcategory explicit itunes_type".split()
    documents = show_config_json(t.shows)
    return documents.select("slug", *[F.get_json_object("document", f"$.{f}").alias(f) for f in fields])


@REGISTRY.add(
    "settings_export",
    """SELECT instance_id, MAX(value) FILTER (WHERE key = 'public_base_url') AS public_base_url,
  MAX(value) FILTER (WHERE key = 'rescan_interval_seconds') AS rescan_interval_seconds,
  CAST(NULL AS VARCHAR) AS session_secret, CAST(NULL AS VARCHAR) AS previous_public_base_url
FROM settings WHERE key IN ('public_base_url', 'default_author_name', 'rescan_interval_seconds', 'missing_grace_seconds', 'watcher_enabled')
GROUP BY instance_id""",
    ("settings",),
)
def _(t):
    fields = ("public_base_url", "rescan_interval_seconds", "session_secret", "previous_public_base_url")
    documents = settings_json(t.settings)
    return documents.select("instance_id", *[F.get_json_object("document", f"$.{f}").alias(f) for f in fields])


@REGISTRY.add("snapshot_roundtrip", "SELECT * FROM login_attempts WHERE succeeded = 0", ("login_attempts",))
def _(t):
    store = Store(t.spark, workspace(t.spark, "store"))
    columns = ("id", "username", "attempted_at", "succeeded")
    first = store.write_snapshot("login_attempts", t.login_attempts)
    store.write_snapshot("login_attempts", store.read("login_attempts").where("succeeded = 0"), expected=first)
    return store.read("login_attempts").select(*columns)


@REGISTRY.add("access_store_roundtrip", "SELECT * FROM media_access WHERE requested_at >= TIMESTAMP '2024-01-10' AND requested_at < TIMESTAMP '2024-01-25'", ("media_access",))
def _(t):
    from medialog.operators.access_log import within
    from medialog.registry.core import FRM, TO

    store = Store(t.spark, workspace(t.spark, "store"))
    store.append_access(t.media_access)
    return within(store.access_log(), FRM, TO).drop("requested_date")
