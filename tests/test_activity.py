from __future__ import annotations

from datetime import timedelta

from conftest import at

from medialog.operators import discover, scan_log, settings, signin, timeline
from medialog.operators.scan_log import ScanFilter
from medialog.schemas import LOGIN_ATTEMPTS, REMOVED_FOLDERS, SCAN_LOG
from test_feeds import shows
from test_reconcile import NOW, T0, episodes

CONFIG = "instance_id STRING, key STRING, value STRING"


def scans(spark, *rows):
    """(id, show, minutes, finished, trigger, added, errors, warnings)"""
    full = [
        (i, show, T0 + timedelta(minutes=m), T0 + timedelta(minutes=m + 1) if done else None, trigger, 1, added, None, 0, 0, errors, warnings, None)
        for i, show, m, done, trigger, added, errors, warnings in rows
    ]
    return spark.createDataFrame(full, SCAN_LOG)


def test_scan_filters(spark):
    log = scans(
        spark, (1, "s", 0, True, "manual", 1, None, None), (2, None, 1, True, "watcher", 0, "[]", None),
        (3, "t", 2, False, "manual", None, None, None), (4, "s", 3, True, "upload", 0, None, '[{"file":"f"}]'),
    )

    def ids(**options):
        return sorted(r.id for r in ScanFilter(**options).apply(log).collect())

    assert ids(show_id="s") == [1, 2, 4] and ids(show_id="s", include_global=False) == [1, 4]
    assert ids(triggers=["manual", "junk"]) == [1, 3] and ids(triggers=["junk"]) == [1, 2, 3, 4]
    assert ids(outcome="problems") == [2, 4] and ids(outcome="errors") == [2] and ids(outcome="clean") == [1]
    assert ids(outcome="changes") == [1] and ids(outcome="running") == [3] and ids(outcome="junk") == [1, 2, 3, 4]
    assert ids(frm=T0 + timedelta(minutes=1), to=T0 + timedelta(minutes=3)) == [2, 3]
    latest = {r.show_id: r.id for r in scan_log.latest_scan(log).collect()}
    assert latest == {"s": 4, None: 2}
    assert [r.id for r in scan_log.trim_scans(log, 2).collect()] == [4, 3]


def test_stored_diagnostics_of_any_kind(spark):
    log = scans(
        spark, (1, "s", 0, True, "manual", 0, '[{"file":"a","message":"m","code":"C"}]', '{"file":"x"}'),
        (2, "s", 1, True, "manual", 0, "nonsense", None), (3, "s", 2, True, "manual", 0, None, ' [{"file":null,"message":"n"}]'),
    )
    got = [(r.scan_id, r.level, r.file, r.message, r.code) for r in scan_log.explode_diagnostics(log).orderBy("scan_id").collect()]
    assert got == [(1, "error", "a", "m", "C"), (3, "warning", None, "n", None)]


def test_entries_are_capped_with_a_count(spark):
    log = scans(spark, (1, "s", 0, True, "manual", 0, "[" + ",".join('{"file":"f%03d"}' % i for i in range(60)) + "]", None))
    row = log.select(scan_log.cap_entries(scan_log.parse_entries(log.errors_json)).alias("e")).first()
    assert len(row.e) == 51 and row.e[49].file == "f049" and row.e[50].file is None and "10 more" in row.e[50].message
    (group,) = scan_log.capped_diagnostics(scan_log.explode_diagnostics(log), ["show_id"], ["file"]).collect()
    assert [tuple(e) for e in group.entries] == [tuple(e) for e in row.e]


def test_one_row_gives_up_to_three_events(spark):
    rows = episodes(
        spark, dict(id="x", filename="x", identity_key="1", status="expired", missing_since=T0, removed_at=NOW),
        dict(id="r", filename="r", identity_key="2", status="removed", removed_at=NOW), dict(id="a", filename="a", identity_key="3", removed_at=NOW),
    )
    dims = shows(spark, dict(id="s", slug="s"))
    got = sorted((r.episode_id, r.event) for r in timeline.episode_timeline(rows, dims).collect())
    assert got == [("a", "added"), ("r", "added"), ("r", "removed"), ("x", "added"), ("x", "expired"), ("x", "missing")]
    assert timeline.count_timeline(rows, dims, kinds=["nonsense"]).first().n == 6
    assert timeline.count_timeline(rows, dims, frm=T0, to=NOW).first().n == 4


def test_backoff_counts_since_the_last_success(spark):
    now = at("2024-01-01T12:00:00")
    rows = [(now - timedelta(seconds=s), u, ok) for s, u, ok in [
        (900, "a", 0), (60, "a", 0), (30, "a", 0), (5, "a", 0), (50, "b", 0), (40, "b", 1), (2, "b", 0), (1, "b", 0), (899, "c", 0)]]
    attempts = spark.createDataFrame([(i, u, t, ok, None) for i, (t, u, ok) in enumerate(rows)], LOGIN_ATTEMPTS)
    got = {r.username: (r.failures, r.wait_seconds) for r in signin.login_backoff(attempts, now).collect()}
    assert got == {"a": (3, 0), "b": (2, 0), "c": (1, 0)}
    sooner = {r.username: r.wait_seconds for r in signin.login_backoff(attempts, now - timedelta(seconds=4)).collect()}
    # A little earlier the oldest failure still counts: four of them, ten seconds, one passed.
    assert sooner["a"] == 9


def test_settings(spark):
    stored = spark.createDataFrame([("i", "public_base_url", "http://a.b/"), ("i", "session_secret", "x"), ("i", "session_ttl_hours", "9999")], CONFIG)
    patch = spark.createDataFrame([("i", "public_base_url", "http://c.d"), ("i", "session_ttl_hours", None)], CONFIG)
    saved = settings.save(stored, patch, NOW)
    got = {r.key: r.value for r in settings.visible(saved).collect()}
    assert got == {"public_base_url": "http://c.d", "previous_public_base_url": "http://a.b", "previous_public_base_url_set_at": "2024-02-01T00:00:00.000Z"}
    typed = settings.typed_settings(saved, NOW + timedelta(days=60)).first()
    assert (typed.public_base_url, typed.previous_base_url, typed.session_ttl_hours) == ("http://c.d", "http://a.b", 12)
    assert settings.typed_settings(saved, NOW + timedelta(days=60, seconds=1)).first().previous_base_url is None
    assert settings.typed_settings(stored, NOW).first().session_ttl_hours == 720
    same = spark.createDataFrame([("i", "public_base_url", "HTTP://A.b//")], CONFIG)
    assert settings.address_moves(stored, same, NOW).count() == 0
    seeded = settings.seed(stored, spark.createDataFrame([("i", "public_base_url", "no"), ("i", "default_language", "fr"), ("i", "x", "")], CONFIG))
    assert {r.key: r.value for r in seeded.collect()} == {"public_base_url": "http://a.b/", "session_secret": "x", "session_ttl_hours": "9999", "default_language": "fr"}


def test_discovery(spark):
    dims = shows(spark, dict(id="a", slug="a"), dict(id="b", slug="b", status="folder_missing"), dict(id="c", slug="c"), dict(id="d", slug="d", status="folder_missing"))
    folders = spark.createDataFrame([("a",), ("b",), ("new",), ("dead",), ("has space",), (".git",)], "slug STRING")
    dead = spark.createDataFrame([("dead", T0)], REMOVED_FOLDERS)
    verdicts = discover.discover(folders, dims, dead)
    assert {r.slug: r.verdict for r in verdicts.collect()} == {
        "a": "present", "b": "returned", "c": "vanished", "d": "still_missing", "new": "new", "dead": "ignored", "has space": "skipped"}
    after = {r.id: (r.status, r.folder_missing_since, r.updated_at) for r in discover.apply_discovery(dims, verdicts, NOW).collect()}
    assert after == {"a": ("active", None, T0), "b": ("active", None, NOW), "c": ("folder_missing", NOW, NOW), "d": ("folder_missing", None, T0)}
    assert discover.forget_removals(dead, folders.where("slug = 'dead'")).count() == 0
