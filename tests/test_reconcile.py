from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import at
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st

from medialog.operators.catalogue import live_row_per_filename
from medialog.operators.lifecycle import apply_decisions, sweep_missing
from medialog.operators.reconcile import reconcile
from medialog.schemas import EPISODES, LISTING

T0 = at("2024-01-01T00:00:00")
NOW = at("2024-02-01T00:00:00")
FILE = dict(show_id="s", size_bytes=10, mtime=T0, identity_key=None, ordinal=None, error_code=None, tag_error=None,
            tag_title=None, tag_description=None, tag_season=None, tag_episode_number=None, duration_seconds=None, bitrate_kbps=None)
ROW = dict(show_id="s", title="T", title_is_custom=0, tag_title=None, description="", season=None, episode_number=None,
           episode_type="full", explicit=None, pub_date=T0, pub_date_is_custom=0, duration_seconds=60, bitrate_kbps=128,
           file_size_bytes=10, file_mtime=T0, mime_type="audio/mpeg", status="active", missing_since=None, removed_at=None,
           art_source=None, art_filename=None, art_sidecar_name=None, art_sidecar_mtime=None, art_width=None,
           art_height=None, art_etag=None, created_at=T0, updated_at=T0)


def frame(spark, ddl, base, rows):
    columns = [f.split()[0] for f in ddl.replace("\n", " ").split(", ")]
    full = [{**base, **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(c.strip()) for c in columns) for r in full], ddl)


def files(spark, *rows):
    return frame(spark, LISTING, FILE, rows)


def episodes(spark, *rows):
    return frame(spark, EPISODES, ROW, rows)


def scan(spark, listing, catalogue, now=NOW, **options):
    done = reconcile(files(spark, *listing), catalogue, now, **options)
    rows = {r.id: r for r in done.episodes.collect()}
    counters = {r.show_id: r for r in done.counters.collect()}
    notes = sorted((r.code, r.file) for r in done.diagnostics.collect())
    return rows, counters, notes


def test_new_files(spark):
    rows, counters, _ = scan(spark, [
        dict(filename="2024-01-05-first_one.mp3", identity_key="a", tag_title="Tagged", tag_season=2, duration_seconds=5),
        dict(filename="second-one.m4a", identity_key="b"), dict(filename="x.jpg"),
    ], episodes(spark))
    by_name = {r.filename: r for r in rows.values()}
    first, second = by_name["2024-01-05-first_one.mp3"], by_name["second-one.m4a"]
    assert (first.title, first.tag_title, first.season, first.duration_seconds, first.pub_date) == ("Tagged", "Tagged", 2, 5, T0)
    assert (second.title, second.mime_type, second.status) == ("Second One", "audio/x-m4a", "active")
    assert (counters["s"].files_found, counters["s"].added) == (2, 2)


def test_rename_keeps_the_id(spark):
    rows, counters, _ = scan(spark, [dict(filename="new.mp3", identity_key="a")], episodes(spark, dict(id="e", filename="old.mp3", identity_key="a")))
    assert rows["e"].filename == "new.mp3" and rows["e"].updated_at == NOW
    assert (counters["s"].added, counters["s"].updated, counters["s"].missing) == (0, 1, 0)


def test_unchanged_file_moves_nothing(spark):
    rows, counters, notes = scan(spark, [dict(filename="a.mp3", identity_key=None)], episodes(spark, dict(id="e", filename="a.mp3", identity_key="a")))
    assert rows["e"].updated_at == T0 and counters["s"].updated == 0 and notes == []


def test_same_name_with_other_bytes_is_another_episode(spark):
    rows, counters, notes = scan(spark, [dict(filename="a.mp3", identity_key="b", size_bytes=11)], episodes(spark, dict(id="e", filename="a.mp3", identity_key="a")))
    assert rows["e"].status == "missing" and len(rows) == 2 and notes == [("gone", "a.mp3")]
    assert (counters["s"].added, counters["s"].missing) == (1, 1)


def test_duplicates_are_stable(spark):
    listing = [dict(filename="z.mp3", identity_key="a", ordinal=1), dict(filename="a.mp3", identity_key="a", ordinal=2)]
    rows, _, notes = scan(spark, listing, episodes(spark))
    assert [r.filename for r in rows.values()] == ["z.mp3"] and notes == [("duplicate", "a.mp3")]
    # The next scan sees the files the other way round and still keeps the known name.
    swapped = [dict(filename="z.mp3", identity_key="a", ordinal=2), dict(filename="a.mp3", identity_key="a", ordinal=1)]
    for rehash in (False, True):
        again, counters, notes = scan(spark, swapped, episodes(spark, dict(id="e", filename="z.mp3", identity_key="a")), rehash=rehash)
        assert again["e"].filename == "z.mp3" and notes == [("duplicate", "a.mp3")] and counters["s"].updated == 0


@pytest.mark.parametrize("status", ["missing", "expired"])
def test_return_with_the_same_id(spark, status):
    stored = episodes(spark, dict(id="e", filename="a.mp3", identity_key="a", status=status, missing_since=T0, removed_at=T0))
    for listing in ([dict(filename="a.mp3", identity_key="a")], [dict(filename="b.mp3", identity_key="a")]):
        rows, counters, notes = scan(spark, listing, stored)
        assert (rows["e"].status, rows["e"].missing_since, rows["e"].removed_at) == ("active", None, None)
        assert counters["s"].updated == 1
        assert [n[0] for n in notes] == (["returned"] if status == "expired" else [])


def test_removed_stays_removed(spark):
    stored = episodes(spark, dict(id="e", filename="a.mp3", identity_key="a", status="removed", removed_at=T0))
    rows, counters, _ = scan(spark, [dict(filename="a.mp3", identity_key="a")], stored)
    assert (rows["e"].status, rows["e"].updated_at, counters["s"].updated) == ("removed", T0, 0)
    rows, counters, _ = scan(spark, [dict(filename="b.mp3", identity_key="a")], stored)
    assert (rows["e"].status, rows["e"].filename, rows["e"].updated_at, counters["s"].updated) == ("removed", "b.mp3", NOW, 0)
    rows, counters, _ = scan(spark, [], stored)
    assert rows["e"].status == "removed" and "s" in counters and counters["s"].missing == 0


def test_unreadable_file_lets_its_row_go_missing(spark):
    rows, counters, notes = scan(spark, [dict(filename="a.mp3", error_code="EACCES")], episodes(spark, dict(id="e", filename="a.mp3", identity_key="a")))
    assert rows["e"].status == "missing" and notes == [("gone", "a.mp3"), ("unreadable", "a.mp3")]
    assert (counters["s"].files_found, counters["s"].missing) == (1, 1)


def test_missing_again_is_counted_not_moved(spark):
    rows, counters, notes = scan(spark, [], episodes(spark, dict(id="e", filename="a.mp3", identity_key="a", status="missing", missing_since=T0)))
    assert (rows["e"].missing_since, rows["e"].updated_at, counters["s"].missing, notes) == (T0, T0, 1, [])


def test_titles_follow_tags_unless_typed(spark):
    tags = dict(tag_title="From Tags", duration_seconds=9, bitrate_kbps=64)
    for custom, title in ((0, "From Tags"), (1, "T")):
        stored = episodes(spark, dict(id="e", filename="a.mp3", identity_key="a", duration_seconds=None, title_is_custom=custom))
        rows, _, _ = scan(spark, [dict(filename="b.mp3", identity_key="a", **tags)], stored)
        assert (rows["e"].title, rows["e"].tag_title, rows["e"].duration_seconds) == (title, "From Tags", 9)


def test_unsupported_files_are_named(spark):
    _, counters, notes = scan(spark, [dict(filename="a.wma"), dict(filename="b.txt"), dict(filename="c.gif")], episodes(spark))
    assert notes == [("unsupported", "a.wma")] and counters == {}


def test_live_row_of_a_shared_name(spark):
    stored = episodes(
        spark, dict(id="a", filename="x.mp3", identity_key="1", status="missing", updated_at=NOW),
        dict(id="b", filename="x.mp3", identity_key="2", status="active"), dict(id="c", filename="x.mp3", identity_key="3", status="active", updated_at=NOW),
    )
    assert [r.id for r in live_row_per_filename(stored).collect()] == ["c"]


def test_grace_is_inclusive(spark):
    stored = episodes(
        spark, dict(id="on", filename="a", identity_key="1", status="missing", missing_since=NOW - timedelta(hours=1)),
        dict(id="late", filename="b", identity_key="2", status="missing", missing_since=NOW - timedelta(minutes=59)),
    )
    rows = {r.id: r for r in sweep_missing(stored, NOW, 3600).collect()}
    assert (rows["on"].status, rows["on"].removed_at, rows["on"].missing_since) == ("expired", NOW, NOW - timedelta(hours=1))
    assert rows["late"].status == "missing"


def test_decisions(spark):
    stored = episodes(spark, dict(id="e", filename="a", identity_key="1", status="missing", missing_since=T0))
    taken = spark.createDataFrame([("e", "restore", 1), ("e", "remove", 2), ("ghost", "remove", 1)], "id STRING, decision STRING, decided_at INT")
    row = apply_decisions(stored, taken, NOW).first()
    assert (row.status, row.removed_at, row.missing_since) == ("removed", NOW, None)


# --- against a file-by-file walk

names = st.sampled_from(["a.mp3", "b.mp3", "c.mp3", "d.mp3"])
keys = st.sampled_from(["1", "2", "3", "4"])
listed = st.lists(
    st.fixed_dictionaries(dict(filename=names, identity_key=keys, size_bytes=st.just(10), mtime=st.sampled_from([T0, NOW]),
                               error_code=st.sampled_from([None, None, None, "EIO"]))),
    unique_by=lambda f: f["filename"], max_size=4,
)
stored = st.lists(
    st.fixed_dictionaries(dict(filename=names, identity_key=keys, status=st.sampled_from(["active", "missing", "expired", "removed"]),
                               updated_at=st.sampled_from([T0, T0 + timedelta(days=1)]))),
    unique_by=lambda e: e["identity_key"], max_size=4,
)


def walk(listing, catalogue):
    """One show, file by file: known names first, then by name."""
    rows = {i: dict(e) for i, e in enumerate(catalogue)}
    rank = {"active": 0, "missing": 1, "expired": 2, "removed": 3}

    def live(name):
        named = [(rank[r["status"]], -r["updated_at"].timestamp(), f"e{i}", i) for i, r in rows.items() if catalogue[i]["filename"] == name]
        return min(named)[3] if named else None

    fast = {}
    for f in listing:
        i = live(f["filename"])
        if f["error_code"] is None and i is not None and f["mtime"] == T0:
            fast[f["filename"]] = i
    counts = dict(added=0, updated=0, missing=0)
    seen, claimed, duplicates = set(), {}, set()
    by_key = {e["identity_key"]: i for i, e in enumerate(catalogue)}

    def order(f):
        key = catalogue[fast[f["filename"]]]["identity_key"] if f["filename"] in fast else f["identity_key"]
        known = key in by_key and catalogue[by_key[key]]["filename"] == f["filename"]
        return (f["filename"] not in fast, not known, f["filename"])

    for f in sorted(listing, key=order):
        if f["error_code"]:
            continue
        is_fast = f["filename"] in fast
        key = catalogue[fast[f["filename"]]]["identity_key"] if is_fast else f["identity_key"]
        if key in claimed:
            duplicates.add(f["filename"])
            continue
        claimed[key] = f["filename"]
        i = by_key.get(key)
        if i is None:
            counts["added"] += 1
            continue
        seen.add(i)
        row, before = rows[i], dict(rows[i])
        if row["status"] == "removed":
            if not is_fast:
                row["filename"] = f["filename"]
            continue
        if not is_fast:
            row["filename"], row["mtime"] = f["filename"], f["mtime"]
        row["status"] = "active"
        counts["updated"] += row != {**before, "mtime": T0} and row != before
    for i, row in rows.items():
        if i not in seen and row["status"] in ("active", "missing"):
            counts["missing"] += 1
            row["status"] = "missing"
    return {f"e{i}": (r["filename"], r["status"]) for i, r in rows.items()}, counts, duplicates


@settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate])
@given(st.lists(st.tuples(listed, stored), min_size=60, max_size=60))
def test_same_as_a_walk(spark, shows):
    """Sixty shows in one pass, each against its own walk; and a second pass changes nothing."""
    listing = [dict(f, show_id=f"s{n}") for n, (fs, _) in enumerate(shows) for f in fs]
    catalogue = [dict(e, show_id=f"s{n}", id=f"s{n}-e{i}") for n, (_, es) in enumerate(shows) for i, e in enumerate(es)]
    done = reconcile(files(spark, *listing), episodes(spark, *catalogue), NOW)
    after = done.episodes.cache()
    got = {r.id: (r.filename, r.status) for r in after.collect()}
    counters = {r.show_id: r for r in done.counters.collect()}
    copies = {(r.show_id, r.file) for r in done.diagnostics.where("code = 'duplicate'").collect()}
    want_copies = set()
    for n, (fs, es) in enumerate(shows):
        rows, counts, duplicates = walk(fs, es)
        assert {i: got[f"s{n}-{i}"] for i in rows} == rows
        row = counters.get(f"s{n}")
        assert {k: (row[k] if row else 0) for k in counts} == counts
        want_copies |= {(f"s{n}", d) for d in duplicates}
    assert copies == want_copies
    assert len(got) == after.select("show_id", "identity_key").distinct().count()
    again = reconcile(files(spark, *listing), after, NOW)
    assert again.changes.where("action NOT IN ('still_missing')").collect() == []
    after.unpersist()


def test_catalogue_is_not_broadcast(spark):
    """However small its files are: in memory it is as large as the listing."""
    listing = spark.createDataFrame([("s", "a.mp3", "i", 1)], "show_id STRING, filename STRING, identity_key STRING, size_bytes BIGINT")
    episodes = spark.createDataFrame([("e", "s", "a.mp3", "i", "active")], "id STRING, show_id STRING, filename STRING, identity_key STRING, status STRING")
    plan = reconcile(listing, episodes, NOW).changes._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
