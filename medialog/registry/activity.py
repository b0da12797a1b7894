"""Registered queries over the scan log and sign-in attempts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from medialog.operators import scan_log, signin
from medialog.operators.scan_log import ScanFilter
from medialog.registry.core import REGISTRY

SCANS = ("shows", "scan_log")
LOGIN = ("login_attempts",)
LOGIN_NOW = datetime(2024, 1, 30, 22, 48, 10)

ENRICHED = "SELECT l.*, s.title AS show_title, s.slug AS show_slug FROM scan_log l LEFT JOIN shows s ON s.id = l.show_id"
FILTERED = """started_at >= TIMESTAMP '1996-01-01' AND started_at < TIMESTAMP '1999-01-01' AND trigger IN ('manual', 'upload')
  AND (errors_json IS NOT NULL OR warnings_json IS NOT NULL) AND (show_id = 'show-7' OR show_id IS NULL)"""
FILTER = ScanFilter(
    show_id="show-7", triggers=["manual", "upload", "junk"], outcome="problems", frm=datetime(1996, 1, 1), to=datetime(1999, 1, 1)
)


@REGISTRY.add("scan_log_filtered", f"SELECT * FROM scan_log WHERE {FILTERED}", ("scan_log",))
def _(t):
    return FILTER.apply(t.scan_log)


@REGISTRY.add(
    "scan_outcomes",
    """SELECT COUNT(*) FILTER (WHERE errors_json IS NOT NULL OR warnings_json IS NOT NULL) AS problems,
  COUNT(*) FILTER (WHERE errors_json IS NOT NULL) AS errors,
  COUNT(*) FILTER (WHERE finished_at IS NOT NULL AND errors_json IS NULL AND warnings_json IS NULL) AS clean,
  COUNT(*) FILTER (WHERE COALESCE(added, 0) + COALESCE(updated, 0) + COALESCE(missing, 0) + COALESCE(removed, 0) > 0) AS changes,
  COUNT(*) FILTER (WHERE finished_at IS NULL) AS running FROM scan_log""",
    ("scan_log",),
)
def _(t):
    outcomes = ("problems", "errors", "clean", "changes", "running")
    return t.scan_log.agg(*[F.count_if(scan_log.outcome_test(o)).alias(o) for o in outcomes])


@REGISTRY.add("scan_log_enriched", ENRICHED, SCANS)
def _(t):
    return scan_log.enrich_scans(t.scan_log, t.shows)


@REGISTRY.add("scan_log_page", ENRICHED + " ORDER BY started_at DESC, l.id DESC LIMIT 25 OFFSET 50", SCANS)
def _(t):
    return scan_log.list_scans(t.scan_log, t.shows, limit=25, offset=50)


@REGISTRY.add(
    "latest_scan",
    """SELECT * EXCLUDE (r) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY show_id ORDER BY started_at DESC, id DESC) AS r
  FROM scan_log WHERE finished_at IS NOT NULL) WHERE r = 1""",
    ("scan_log",),
)
def _(t):
    return scan_log.latest_scan(t.scan_log)


@REGISTRY.add("scan_log_count", f"SELECT COUNT(*) AS n FROM scan_log WHERE {FILTERED}", ("scan_log",))
def _(t):
    return scan_log.count_scans(t.scan_log, FILTER)


@REGISTRY.add("scan_log_retained", "SELECT * FROM scan_log ORDER BY started_at DESC, id DESC LIMIT 500", ("scan_log",))
def _(t):
    return scan_log.trim_scans(t.scan_log, 500)


DIAGNOSTICS = """dg AS (SELECT id AS scan_id, show_id, level, json_extract_string(e, '$.file') AS file,
  json_extract_string(e, '$.message') AS message, json_extract_string(e, '$.code') AS code FROM (
  SELECT id, show_id, 'error' AS level, UNNEST(json_extract(errors_json, '$[*]')) AS e FROM scan_log WHERE errors_json LIKE '[%'
  UNION ALL SELECT id, show_id, 'warning', UNNEST(json_extract(warnings_json, '$[*]')) FROM scan_log WHERE warnings_json LIKE '[%'))"""


@REGISTRY.add("scan_diagnostics", f"WITH {DIAGNOSTICS} SELECT * FROM dg", ("scan_log",))
def _(t):
    return scan_log.explode_diagnostics(t.scan_log)


@REGISTRY.add(
    "diagnostics_capped",
    f"""WITH {DIAGNOSTICS}, rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY show_id, level ORDER BY scan_id, file, message) AS r,
  COUNT(*) OVER (PARTITION BY show_id, level) AS n FROM dg)
SELECT show_id, level, n, CAST(r - 1 AS INT) AS position, file, message, code FROM rk WHERE r <= 50
UNION ALL SELECT show_id, level, n, 50, NULL, '…and ' || (n - 50) || ' more like these.', NULL FROM rk WHERE r = 1 AND n > 50""",
    ("scan_log",),
)
def _(t):
    rows = scan_log.explode_diagnostics(t.scan_log)
    capped = scan_log.capped_diagnostics(rows, ["show_id", "level"], ["scan_id", "file", "message"])
    return capped.select("show_id", "level", "n", F.posexplode("entries").alias("position", "e")).select(
        "show_id", "level", "n", "position", "e.file", "e.message", "e.code"
    )


@REGISTRY.add(
    "scan_totals",
    f"""WITH {DIAGNOSTICS}, d AS (SELECT l.trigger, COUNT(*) FILTER (WHERE level = 'error') AS errors,
  COUNT(*) FILTER (WHERE level = 'warning') AS warnings FROM dg JOIN scan_log l ON l.id = dg.scan_id GROUP BY 1)
SELECT l.trigger, COUNT(*) AS shows, CAST(SUM(files_found) AS BIGINT) AS files_found, CAST(SUM(added) AS BIGINT) AS added,
  CAST(SUM(updated) AS BIGINT) AS updated, CAST(SUM(missing) AS BIGINT) AS missing, CAST(SUM(removed) AS BIGINT) AS removed,
  ANY_VALUE(d.errors) AS errors, ANY_VALUE(d.warnings) AS warnings FROM scan_log l LEFT JOIN d ON d.trigger = l.trigger GROUP BY l.trigger""",
    ("scan_log",),
)
def _(t):
    return scan_log.scan_totals(t.scan_log, ["trigger"])


@REGISTRY.add(
    "library_diagnostics",
    f"""WITH {DIAGNOSTICS}, rk AS (SELECT l.trigger, dg.*, ROW_NUMBER() OVER (PARTITION BY l.trigger, level ORDER BY scan_id, file, message) AS r,
  COUNT(*) OVER (PARTITION BY l.trigger, level) AS n FROM dg JOIN scan_log l ON l.id = dg.scan_id)
SELECT trigger, level, n, CAST(r - 1 AS INT) AS position, file, message FROM rk WHERE r <= 50
UNION ALL SELECT trigger, level, n, 50, NULL, '…and ' || (n - 50) || ' more like these.' FROM rk WHERE r = 1 AND n > 50""",
    ("scan_log",),
)
def _(t):
    capped = scan_log.library_diagnostics(t.scan_log, ["trigger"])
    return capped.select("trigger", "level", "n", F.posexplode("entries").alias("position", "e")).select(
        "trigger", "level", "n", "position", "e.file", "e.message"
    )


@REGISTRY.add(
    "login_backoff",
    """WITH r AS (SELECT * FROM login_attempts WHERE attempted_at > TIMESTAMP '2024-01-30 22:33:10' AND attempted_at <= TIMESTAMP '2024-01-30 22:48:10'),
s AS (SELECT username, MAX(attempted_at) AS ok_at FROM r WHERE succeeded = 1 GROUP BY username),
f AS (SELECT r.username, COUNT(*) AS failures, MAX(attempted_at) AS last_failure_at FROM r LEFT JOIN s ON s.username = r.username
  WHERE succeeded = 0 AND (ok_at IS NULL OR attempted_at > ok_at) GROUP BY r.username)
SELECT username, failures, last_failure_at, CAST(CASE WHEN [0, 0, 1, 3, 10, 30, 60, 120, 300][LEAST(failures, 8) + 1] = 0 THEN 0
  ELSE GREATEST(0, CEIL([0, 0, 1, 3, 10, 30, 60, 120, 300][LEAST(failures, 8) + 1] - epoch_us(TIMESTAMP '2024-01-30 22:48:10') / 1e6 + epoch_us(last_failure_at) / 1e6)) END AS BIGINT) AS wait_seconds FROM f""",
    LOGIN,
)
def _(t):
    return signin.login_backoff(t.login_attempts, LOGIN_NOW)



@REGISTRY.add(
    "login_failures_trailing",
    """SELECT id, username, attempted_at, succeeded, COUNT(*) FILTER (WHERE succeeded = 0) OVER (PARTITION BY username ORDER BY attempted_at
  RANGE BETWEEN INTERVAL 15 MINUTE PRECEDING AND CURRENT ROW) AS trailing_failures FROM login_attempts""",
    LOGIN,
)
def _(t):
    return signin.trailing_failures(t.login_attempts)


@REGISTRY.add(
    "login_failures_90_minutes",
    """SELECT id, username, attempted_at, succeeded, COUNT(*) FILTER (WHERE succeeded = 0) OVER (PARTITION BY username ORDER BY attempted_at
  RANGE BETWEEN INTERVAL 90 MINUTE PRECEDING AND CURRENT ROW) AS trailing_failures FROM login_attempts""",
    LOGIN,
)
def _(t):
    return signin.trailing_failures(t.login_attempts, minutes=90)


@REGISTRY.add(
    "attempts_retained", "SELECT * FROM login_attempts WHERE attempted_at >= TIMESTAMP '2024-01-29 22:48:10'", LOGIN
)
def _(t):
    return signin.trim_attempts(t.login_attempts, LOGIN_NOW)
