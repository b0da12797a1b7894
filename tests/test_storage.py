from __future__ import annotations

import hashlib
import os
from datetime import timedelta
from pathlib import Path

import pytest
from conftest import at
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from test_access import BASE, log_of
from test_feeds import shows
from test_reconcile import NOW, T0, episodes, files
from test_streaming import raw

from medialog.operators import artwork, discover, lifecycle, patches, rollups
from medialog.operators.access_log import AccessFilter, enrich_log, trim_access, within
from medialog.operators.reconcile import conform
from medialog.plans import buckets, stored_log
from medialog.plans.library_scan import NewShows, listed_files, store_sweep, sweep
from medialog.plans.stats_page import stats_page
from medialog.schemas import EPISODES, REMOVED_FOLDERS, SCAN_LOG
from medialog.sources import export, listing, show_config
from medialog.sources.requests import enrich_requests
from medialog.sources.store import TABLES, Store, append_log, read_log
from medialog.streaming import ingest


def put(path: Path, data: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def identity(data: bytes) -> str:
    window = listing.WINDOW_BYTES
    kept = data if len(data) <= 2 * window else data[:window] + data[-window:]
    return hashlib.sha256(kept + str(len(data)).encode()).hexdigest()


def test_listing_and_identity(spark, tmp_path):
    root = tmp_path / "shows root"
    big = os.urandom(3 * 1024 * 1024)
    same_ends = big[: 2**20] + b"x" * (len(big) - 2**21) + big[-(2**20):]
    content = {"a/one two.mp3": b"abc", "a/big.mp3": big, "a/ends.mp3": same_ends, "b/empty.mp3": b"", "b/é.wav": b"abc", "b/_x.mp3": b"x"}
    for name, data in content.items():
        put(root / name, data)
    put(root / "a/deeper/x.mp3", b"no")
    put(root / "a/.hidden.mp3", b"no")
    put(root / ".cache/y.mp3", b"no")
    put(root / "top.mp3", b"no")
    (root / "empty").mkdir()
    library = listing.read_library(spark, str(root))
    assert {tuple(r) for r in listing.folders_of(library).collect()} == {("a", None), ("b", None), ("empty", None)}
    found = listing.files_of(library)
    rows = {f"{r.slug}/{r.filename}": r for r in listing.with_identity(found).collect()}
    assert {n: r.identity_key for n, r in rows.items()} == {n: identity(d) for n, d in content.items()}
    assert {n: r.size_bytes for n, r in rows.items()} == {n: len(d) for n, d in content.items()}
    assert rows["a/big.mp3"].identity_key == rows["a/ends.mp3"].identity_key, "the middle is not read"


def test_unreadable_file_is_reported(spark, tmp_path):
    df = spark.createDataFrame([("a", "gone.mp3", f"file:{tmp_path}/gone.mp3", 3)], "slug STRING, filename STRING, path STRING, size_bytes BIGINT")
    row = listing.with_identity(df).first()
    assert row.identity_key is None and row.error_code == "FileNotFoundError"


def test_unreadable_folder_is_reported(spark, tmp_path):
    folder = spark.createDataFrame([("a", f"{tmp_path}/gone"), ("b", "nosuchstore://x/y")], "slug STRING, path STRING")
    rows = {r.slug: r for r in folder.mapInPandas(listing._entries, listing._ENTRY).collect()}
    assert rows["a"].error_code == "FileNotFoundError" and rows["b"].error_code and rows["a"].filename is None


def test_identity_windows_of_bytes_at_hand(spark):
    data = [b"", b"abc", b"abcdefgh", b"abcdefghi"]
    df = spark.createDataFrame([(bytearray(d),) for d in data], "c BINARY")
    got = [r[0] for r in df.select(listing.content_identity(F.col("c"), window=4)).collect()]
    assert got == [hashlib.sha256((d if len(d) <= 8 else d[:4] + d[-4:]) + str(len(d)).encode()).hexdigest() for d in data]


def test_show_config_files(spark, tmp_path):
    put(tmp_path / "lib/a+b/show.json", '{\n "title": "T", "author": "A", "explicit": true,\n "category": "Arts → Books"}'.encode())
    put(tmp_path / "lib/bad/show.json", b"{nope")
    got = {r.slug: r for r in show_config.parse_show_config(show_config.read_show_config(spark, f"{tmp_path}/lib")).collect()}
    assert got["bad"].found is False and got["bad"].title is None
    row = got["a+b"]
    assert (row.found, row.title, row.author_name, row.explicit, row.category, row.subcategory) == (True, "T", "A", True, "Arts", "Books")


def test_csv_file(spark, tmp_path):
    log = log_of(spark, [
        (1, 0, "download", 200, 5, 1000, "Overcast", "e1", "s"), (2, 0, "stream", 206, 5, 1000, None, "gone", "s"), (3, 1, "download", 404, None, 9, "VLC", "e2", "s"),
    ])
    eps = episodes(spark, dict(id="e1", filename="a.mp3", identity_key="1", title='Say "hi", now'), dict(id="e2", filename="b.mp3", identity_key="2", title="=1+1\nx"))
    export.export_access_log(log, eps, shows(spark, dict(id="s", slug="s")), f"{tmp_path}/csv")
    whole = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("*.txt")))
    assert whole.decode("utf8") == (
        "﻿requested_at_utc,show,episode,filename,kind,status_code,result,bytes_sent,total_bytes,range_header,app,error\r\n"
        "2024-03-01T00:01:00.000Z,Show & <Co>,\"'=1+1\nx\",b.mp3,download,404,failed,,9,,VLC,\r\n"
        "2024-03-01T00:00:00.000Z,Show & <Co>,,,stream,206,ok,5,1000,,,\r\n"
        '2024-03-01T00:00:00.000Z,Show & <Co>,"Say ""hi"", now",a.mp3,download,200,partial,5,1000,,Overcast,\r\n'
    )


@pytest.mark.parametrize("sort, column", [("time", 0), ("bytes", 7), ("status", 5), ("kind", 4), ("client", 10)])
@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_export_has_every_row_in_order(spark, tmp_path, sort, column, direction):
    log = log_of(spark, [(i, i % 50, ("download", "stream")[i % 2], 200 + i % 3, 100 + i % 7, 5, f"c{i % 4}", "e", "s") for i in range(500)])
    export.export_access_log(log, episodes(spark), shows(spark), f"{tmp_path}/csv", AccessFilter(), sort, direction)
    lines = [ln for f in sorted((tmp_path / "csv").glob("*.txt")) for ln in f.read_text("utf8").split("\n") if ln]
    keys = [ln.split(",")[column] for ln in lines[1:]]
    assert len(keys) == 500 and keys == sorted(keys, reverse=direction == "desc") and lines[0].startswith("﻿requested_at_utc")


def test_snapshots_are_versioned(spark, scratch):
    store = Store(spark, scratch)
    assert store.current("episodes") == 0 and store.read("episodes").count() == 0
    first = store.write_snapshot("episodes", episodes(spark, dict(id="e", filename="a", identity_key="1")))
    # A table may be replaced by a change of itself.
    store.write_snapshot("episodes", store.read("episodes").withColumn("title", F.lit("new")), expected=first)
    assert store.read("episodes").first().title == "new" and store.current("episodes") == 2
    with pytest.raises(AnalysisException):
        store.write_snapshot("episodes", store.read("episodes"), expected=first)


def test_every_table_comes_back_as_it_went(spark, scratch):
    store = Store(spark, scratch)
    for name, schema in TABLES.items():
        empty = spark.createDataFrame([], schema)
        assert store.write_snapshot(name, empty) == 1 and store.current(name) == 1
        assert store.read(name).schema == empty.schema and store.read(name).count() == 0
    rows = spark.createDataFrame([("i", "public_base_url", "u")], TABLES["settings"])
    store.write_snapshot("settings", rows, expected=1)
    assert store.read("settings").collect() == rows.collect() and store.read("settings", 1).count() == 0


def test_stream_appends_and_retention_on_one_log(spark, scratch):
    store = Store(spark, scratch)
    store.append_access(log_of(spark, [(i, i * 720, "download", 200, 1, 1, None, "e", "s") for i in range(10)]), "first")
    put_raw = raw(spark, [3, 3, 50, 51])
    put_raw.coalesce(1).write.json(f"{scratch}/in")
    stream = ingest.raw_stream(spark, f"{scratch}/in")
    ingest.ingest(stream, f"{scratch}/media_access", f"{scratch}/check").awaitTermination()
    ids = lambda: sorted(r.id for r in store.access_log().collect())
    # Response 3 of the stream is of another day than row 3 of the log.
    assert ids() == sorted([*range(10), *[r.id for r in enrich_requests(raw(spark, [3, 50, 51])).collect()]])
    store.append_access(log_of(spark, [(99, 0, "download", 200, 1, 1, None, "e", "s")]))
    assert 99 in ids()
    store.append_access(log_of(spark, [(98, 1, "download", 200, 1, 1, None, "e", "s")]), "first")
    assert 98 in ids() and 9 in ids(), "a batch replaces its own rows of the days it has"
    store.drop_days_before(BASE + timedelta(days=3, hours=6), days=1)
    assert min(r.requested_at for r in store.access_log().collect()) >= BASE + timedelta(days=2)
    store.append_access(log_of(spark, [(97, 9 * 720, "download", 200, 1, 1, None, "e", "s")]))
    assert 97 in ids()


def test_appends_make_few_files(spark, scratch):
    store = Store(spark, scratch)
    store.append_access(log_of(spark, [(i, i * 60, "download", 200, 1, 1, None, "e", f"s{i % 9}") for i in range(240)]).repartition(8))
    assert len(list(Path(scratch).rglob("*.parquet"))) <= 10 + 8


def test_day_partitions_are_pruned(spark, scratch):
    store = Store(spark, scratch)
    store.append_access(log_of(spark, [(i, i * 600, "download", 200, 1, 1, None, "e", "s") for i in range(20)]))
    some = within(store.access_log(), BASE + timedelta(days=2), BASE + timedelta(days=3, hours=1))
    assert sorted(r.id for r in some.collect()) == list(range(5, 8))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(requested_date" in plan and "PushedFilters: [IsNotNull(requested_at), GreaterThanOrEqual(requested_at" in plan


def test_sweep_stores_a_whole_library(spark, scratch):
    store = Store(spark, scratch)
    dims = shows(spark, dict(id="s", slug="on-disk"), dict(id="g", slug="gone"))
    eps = episodes(
        spark, dict(id="keep", filename="a.mp3", identity_key="a"), dict(id="lost", filename="b.mp3", identity_key="b"),
        dict(id="far", show_id="g", filename="c.mp3", identity_key="c"),
        dict(id="old", filename="o.mp3", identity_key="o", status="missing", missing_since=T0),
    )
    base = {"scan_log": 0, "shows": store.write_snapshot("shows", dims)}
    base["episodes"] = store.write_snapshot("episodes", eps)
    found = files(spark, dict(filename="a.mp3", identity_key="a"), dict(filename="n.mp3", identity_key="n"), dict(filename="n.JPG"), dict(filename="x.wma"))
    folders = spark.createDataFrame([("on-disk",), ("fresh",), ("bad name",)], "slug STRING")
    images = spark.createDataFrame([("s", "n.JPG", "sidecar", "n.jpg", 1500, 1500, "tag")],
                                   "show_id STRING, filename STRING, source STRING, stored_name STRING, width INT, height INT, etag STRING")
    result = sweep(found, folders, store.read("shows"), store.read("episodes"), spark.createDataFrame([], REMOVED_FOLDERS), images, NOW, "k1", 3600)
    store_sweep(store, result, NOW, NOW + timedelta(seconds=5), "manual", base)
    rows = {r.id: r for r in store.read("episodes").collect()}
    assert {k: rows[k].status for k in ("keep", "lost", "far", "old")} == {"keep": "active", "lost": "missing", "far": "active", "old": "expired"}
    (new,) = [r for r in rows.values() if r.filename == "n.mp3"]
    assert (new.art_source, new.art_sidecar_name, new.art_etag) == ("sidecar", "n.JPG", "tag")
    assert rows["keep"].updated_at == T0
    assert {r.slug: r.verdict for r in result.folder_verdicts.collect()} == {
        "on-disk": "present", "fresh": "new", "bad name": "skipped", "gone": "vanished"}
    assert {r.id: r.status for r in store.read("shows").collect()} == {"s": "active", "g": "folder_missing"}
    scans = {r.show_id: r for r in store.read("scan_log").collect()}
    whole, scan = scans[None], scans["s"]
    assert len(scans) == 2 and whole.id != scan.id and (whole.files_found, whole.added) == (2, 1)
    assert all(word in whole.warnings_json for word in ("gone", "bad name"))
    assert (scan.show_id, scan.files_found, scan.added, scan.missing, scan.trigger) == ("s", 2, 1, 2, "manual")
    assert "b.mp3" in scan.warnings_json and "x.wma" in scan.warnings_json and scan.errors_json is None


def test_unchanged_art_moves_nothing(spark):
    eps = conform(episodes(spark, dict(id="e", filename="a.mp3", identity_key="a", art_source="sidecar", art_filename="a.jpg",
                                       art_sidecar_name="a.jpg", art_sidecar_mtime=T0, art_width=1, art_height=1, art_etag="t")), EPISODES)
    found = files(spark, dict(filename="a.mp3"), dict(filename="a.jpg"))

    def stored(etag):
        return spark.createDataFrame([("s", "a.jpg", "sidecar", "a.jpg", 1, 1, etag)],
                                     "show_id STRING, filename STRING, source STRING, stored_name STRING, width INT, height INT, etag STRING")

    assert artwork.art_changes(eps, artwork.choose_art(eps, artwork.sidecar_art(found), stored("t"))).count() == 0
    moved = artwork.art_changes(eps, artwork.choose_art(eps, artwork.sidecar_art(found), stored("u")))
    assert moved.first().changed == ["art_etag"]
    assert artwork.apply_art(eps, moved, NOW).first().updated_at == NOW


def test_new_shows_and_patches(spark):
    verdicts = spark.createDataFrame([("late-night_club", None, "new"), ("x", None, "skipped")], "slug STRING, show_id STRING, verdict STRING")
    configs = show_config.parse_show_config(spark.createDataFrame([("late-night_club", '{"author": "Me"}')], "slug STRING, text STRING"))
    rows = discover.new_shows(verdicts, configs, {"author_email": "h@x.y", "language": "en", "category": "Arts"}, NOW, "k", "secret")
    (row,) = rows.collect()
    assert (row.title, row.author_name, row.author_email, row.itunes_category, row.status) == ("Late Night Club", "Me", "h@x.y", "Arts", "active")
    assert len(row.feed_token) >= 32 and row.explicit == 0 and row.itunes_type == "episodic"
    edits = spark.createDataFrame([(row.id, " New ", "nope")], "id STRING, title STRING, language STRING")
    refused = patches.apply_patches(rows, edits, patches.show_rules(), NOW).first()
    assert refused.title == "Late Night Club" and list(refused.errors) == ["language"]


def test_removing_shows(spark):
    tables = {
        "shows": shows(spark, dict(id="s", slug="one"), dict(id="t", slug="two")),
        "episodes": episodes(spark, dict(id="e", filename="a", identity_key="1"), dict(id="f", show_id="t", filename="a", identity_key="1")),
        "scan_log": spark.createDataFrame([], SCAN_LOG),
        "removed_folders": spark.createDataFrame([("one", T0)], REMOVED_FOLDERS),
    }
    ids = spark.createDataFrame([("s",)], "show_id STRING")
    left = lifecycle.remove_shows(tables, ids, NOW)
    assert [r.id for r in left["shows"].collect()] == ["t"] and [r.id for r in left["episodes"].collect()] == ["f"]
    assert [tuple(r) for r in left["removed_folders"].collect()] == [("one", NOW)]
    assert lifecycle.remove_shows(tables, ids, NOW, files_too=True)["removed_folders"].first().removed_at == T0


@pytest.mark.parametrize("key", ["7d", "all"])
def test_stats_page_parts_agree(spark, key):
    log = log_of(spark, [(i, i * 700, ("download", "stream", "feed")[i % 3], 200 if i % 6 else 500, 3, 9, "Castro", "e", "s") for i in range(40)])
    eps, dims = episodes(spark, dict(id="e", filename="a", identity_key="1")), shows(spark, dict(id="s", slug="s"), dict(id="t", slug="t"))
    now = at("2024-03-20T09:00:00")
    parts = stats_page(log, eps, dims, key, now, "Europe/London", AccessFilter(kinds=["download"]))
    total = parts["overview"].first()
    daily = parts["daily"].agg(F.sum("downloads"), F.sum("streams"), F.sum("failures"), F.sum("bytes")).first()
    assert tuple(daily) == (total.downloads, total.streams, total.failures, total.bytes)
    per_show = {r.show_id: r for r in parts["shows"].collect()}
    assert per_show["s"].downloads == total.downloads and per_show["t"].downloads == 0
    assert parts["busiest"].first().downloads == total.downloads
    assert parts["total"].first().n == parts["entries"].count() if key == "7d" else True
    assert parts["clients"].first().n == total.downloads + total.streams
    assert parts["failures"].count() > 0 and parts["client_shares"].first().share == 100


def test_days_past_retention_are_deleted(spark, scratch):
    store = Store(spark, scratch)
    store.append_access(log_of(spark, [(i, i * 720, "download", 200, 1, 1, None, "e", "s") for i in range(10)]))
    now = BASE + timedelta(days=3, hours=6)
    assert store.drop_days_before(now, days=1) == ["2024-03-01", "2024-03-02"]
    left = store.access_log()
    assert sorted(r.id for r in left.collect()) == [4, 5, 6, 7, 8, 9]
    assert sorted(r.id for r in trim_access(left, now, 1).collect()) == [5, 6, 7, 8, 9]


def test_a_folder_scanned_twice(spark, tmp_path):
    """From files on disk to the catalogue: only what changed is opened, and ids survive a rename."""
    root = tmp_path / "library"
    for name in ("club/one.mp3", "club/two.m4a", "club/two.jpg", "club/note.wma", "other/x.mp3"):
        put(root / name, name.encode())
    dims = shows(spark, dict(id="c", slug="club"), dict(id="o", slug="other"))
    none = spark.createDataFrame([], REMOVED_FOLDERS)

    def run(catalogue, key, dims=dims, folders=None, create=None):
        library = listing.read_library(spark, str(root))
        files_now = listed_files(library, dims, catalogue)
        out = sweep(files_now, folders or listing.folders_of(library), dims, catalogue, none, None, NOW, key, create=create)
        return files_now, out, {r.filename: r for r in out.episodes.collect()}

    _, _, first = run(episodes(spark), "k1")
    assert set(first) == {"one.mp3", "two.m4a", "x.mp3"}
    assert first["one.mp3"].identity_key == identity(b"club/one.mp3")
    saved = spark.createDataFrame(list(first.values()), EPISODES)

    (root / "club/one.mp3").rename(root / "club/uno.mp3")
    (root / "club/two.m4a").unlink()
    put(root / "club/copy.mp3", b"other/x.mp3")
    put(root / "club/copy2.mp3", b"other/x.mp3")
    listing_now, out, second = run(saved, "k2")
    assert second["uno.mp3"].id == first["one.mp3"].id and second["two.m4a"].status == "missing"
    assert second["copy.mp3"].show_id == "c" and second["copy.mp3"].id != first["x.mp3"].id
    assert second["x.mp3"] == first["x.mp3"]
    assert {(r.code, r.file) for r in out.diagnostics.collect()} == {
        ("unsupported", "note.wma"), ("gone", "two.m4a"), ("duplicate", "copy2.mp3")}
    assert {r.show_id: (r.files_found, r.added, r.updated, r.missing) for r in out.counters.collect()} == {
        "c": (3, 1, 1, 1), "o": (1, 0, 0, 0)}
    assert {r.verdict for r in out.folder_verdicts.collect()} == {"present"}

    # An emptied folder: its episodes go missing. One that cannot be read: they stay as they are.
    (root / "other/x.mp3").unlink()
    put(root / "fresh/_new.mp3", b"new")
    put(root / "fresh/cover.png", b"png")
    put(root / "fresh/show.json", b'{"title": "Brand new", "author": "A"}')
    unread = spark.createDataFrame([("club", "PermissionError"), ("other", None), ("fresh", None)], "slug STRING, error_code STRING")
    configs = show_config.parse_show_config(show_config.read_show_config(spark, str(root)))
    saved = spark.createDataFrame(list(second.values()), EPISODES)
    _, out, third = run(saved, "k3", folders=unread, create=NewShows(configs, {"language": "de"}, "secret"))
    assert third["x.mp3"].status == "missing" and third["uno.mp3"] == second["uno.mp3"]
    found = {r.slug: r for r in out.shows.collect()}
    assert (found["fresh"].title, found["fresh"].author_name, found["fresh"].language) == ("Brand new", "A", "de")
    assert (found["fresh"].cover_filename, found["fresh"].cover_format) == ("cover.png", "png")
    assert third["_new.mp3"].show_id == found["fresh"].id and third["_new.mp3"].status == "active"
    assert found["club"].updated_at == {r.slug: r for r in dims.collect()}["club"].updated_at


def test_a_crashed_snapshot_is_replaced(spark, scratch):
    store = Store(spark, scratch)
    rows = spark.createDataFrame([("i", "k", "v")], TABLES["settings"])
    for version in (1, 2):
        left = Path(scratch, "settings", f"version={version}", "_temporary", "0")
        left.mkdir(parents=True)
        (left / "part-0.parquet").write_bytes(b"half a file")
        assert store.current("settings") == version - 1
        assert store.write_snapshot("settings", rows) == version == store.current("settings")
        assert store.read("settings").collect() == rows.collect()


def test_a_sweep_is_stored_again_after_a_crash(spark, tmp_path, monkeypatch):
    found = files(spark, dict(filename="a.mp3", identity_key="a"), *[dict(filename=f"x{k}.wma") for k in range(60)])
    folders = spark.createDataFrame([("on-disk",)], "slug STRING")
    real, stored = Store.write_snapshot, []
    for step in range(4):
        store = Store(spark, str(tmp_path / f"store{step}"))
        base = {"scan_log": 0, "shows": store.write_snapshot("shows", shows(spark, dict(id="s", slug="on-disk")))}
        base["episodes"] = store.write_snapshot("episodes", episodes(spark, dict(id="lost", filename="b.mp3", identity_key="b")))

        def once(calls=[step]):  # noqa: B006
            def write(self, *args, **named):
                if not calls[0]:
                    raise OSError("crash")
                calls[0] -= 1
                return real(self, *args, **named)

            return write

        result = sweep(found, folders, store.read("shows"), store.read("episodes"), spark.createDataFrame([], REMOVED_FOLDERS), None, NOW, "k1", 3600)
        monkeypatch.setattr(Store, "write_snapshot", once())
        if step < 3:
            with pytest.raises(OSError, match="crash"):
                store_sweep(store, result, NOW, NOW, "manual", base)
        monkeypatch.setattr(Store, "write_snapshot", real)
        store_sweep(store, result, NOW, NOW, "manual", base)
        assert store.current("episodes") == 2 and store.current("shows") == 2 and store.current("scan_log") == 1
        stored.append((sorted(store.read("episodes").collect(), key=str), sorted(store.read("scan_log").collect(), key=str)))
        # Another sweep from the same base does not pass for this one.
        with pytest.raises(AnalysisException):
            store_sweep(store, result, NOW + timedelta(seconds=1), NOW, "manual", base)
    assert all(x == stored[0] for x in stored)
    assert store.diagnostics().where("file LIKE 'x%'").count() == 60


def test_buckets_are_joined_where_they_lie(spark, scratch):
    eps = episodes(spark, *[dict(id=f"e{k}", filename=f"{k}.mp3", identity_key=str(k)) for k in range(12)])
    # One episode has half of all rows, another third have none.
    rows = [(i, i % 700, "download", 200, 5, 9, None, "e1" if i % 2 else (f"e{i % 11}" if i % 3 else None), "s") for i in range(900)]
    log, dims = log_of(spark, rows), shows(spark, dict(id="s", slug="one"))
    made = buckets.write_buckets(log, eps, f"{scratch}/b", 8)
    sizes = [r["count"] for r in made.log.groupBy(F.input_file_name()).count().collect()]
    assert max(sizes) < 900 / 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = made.log.join(made.episodes.select(buckets.KEY, "title"), buckets.KEY, "left")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        counted = made.log.groupBy(buckets.KEY, "episode_id").count()
        assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = enrich_log(log, eps, dims)
    got = buckets.enrich_log(made, dims).select(*want.columns)
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert buckets.busiest(made, dims).select("episode_id", "downloads").collect() == rollups.busiest(log, eps, dims).select("episode_id", "downloads").collect()


def test_counts_and_extent_come_from_footers(spark, scratch):
    log = log_of(spark, [(i, i * 77, "download", 200, 5, 9, None, "e", f"s{i % 3}") for i in range(300)])
    append_log(log.where("id % 2 = 0"), scratch, "a")
    append_log(log.where("id % 2 = 1"), scratch, "b")
    counts = stored_log.day_counts(spark, scratch)
    assert "PushedAggregation: [COUNT(*)]" in counts._jdf.queryExecution().executedPlan().toString()
    assert counts.agg(F.sum("n")).first()[0] == 300
    assert stored_log.count_days(spark, scratch, (BASE + timedelta(days=2)).date(), (BASE + timedelta(days=5)).date()).first().n == within(
        log, BASE + timedelta(days=2), BASE + timedelta(days=5)
    ).count()
    extent = stored_log.stored_extent(spark, scratch)
    assert extent.first() == (BASE, BASE + timedelta(minutes=299 * 77))
    assert len({f.split("requested_date=")[1][:10] for f in extent._jdf.queryExecution().executedPlan().toString().split() if "requested_date=" in f}) <= 2
    empty = f"{scratch}/none"
    assert stored_log.stored_extent(spark, empty).first() == (None, None) and stored_log.count_days(spark, empty).first().n == 0


def test_deletion_rewrites_only_files_with_such_rows(spark, scratch, monkeypatch):
    log = log_of(spark, [(i, i * 77, "download", 200, 5, 9, None, "e", "gone" if i in (5, 6, 150) else (None if i % 9 == 0 else "s")) for i in range(300)])
    append_log(log, scratch, "a b")
    names = lambda: {str(p.relative_to(scratch)) for p in Path(scratch).rglob("part-*.parquet") if "_staged" not in str(p)}
    before = names()
    # A crash after the plan: old files are half deleted.
    real, left = stored_log.remove_folder, [0]

    def crash(path):
        left[0] += 1
        if left[0] == 1:
            raise OSError("crash")
        real(path)

    monkeypatch.setattr(stored_log, "remove_folder", crash)
    with pytest.raises(OSError, match="crash"):
        stored_log.drop_show(spark, scratch, "gone")
    assert stored_log.drop_show(spark, scratch, "gone") == []
    after = names()
    assert sorted(r.id for r in read_log(spark, scratch).collect()) == [i for i in range(300) if i not in (5, 6, 150)]
    assert 1 <= len(before - after) <= 2 and len(before & after) >= 14
    assert not [f for f in Path(scratch).iterdir() if f.name.startswith("_staged")]
    # Staged rows without a plan change nothing.
    Path(scratch, "_staged-x", "rows").mkdir(parents=True)
    assert stored_log.delete_rows(spark, scratch, F.col("requested_at") < F.lit(BASE + timedelta(minutes=100))) != []
    assert read_log(spark, scratch).count() == 295 and not Path(scratch, "_staged-x").exists()


def test_a_filter_on_one_episode_reads_few_row_groups(spark, scratch):
    rows = spark.range(400_000).select(
        "id", F.concat(F.lit("episode-"), F.sha2(F.pmod(F.xxhash64("id"), F.lit(20_000)).cast("string").cast("binary"), 256)).alias("episode_id"),
        F.concat(F.lit("show-"), F.pmod(F.xxhash64("id"), F.lit(20)).cast("string")).alias("show_id"),
        (F.lit(BASE).cast("timestamp") + F.make_dt_interval(secs=(F.col("id") % 80_000).cast("int"))).alias("requested_at"),
        F.lit("download").alias("kind"), F.lit(200).alias("status_code"), *[F.lit(1).cast("bigint").alias(c) for c in ("bytes_sent", "total_bytes")],
        *[F.lit(None).cast("string").alias(c) for c in ("range_header", "client", "error")],
    )
    append_log(rows, scratch, "a", 1 << 20)
    wanted = rows.first().episode_id
    found = read_log(spark, scratch).where(F.col("episode_id") == wanted)
    n = found.count()
    assert n == rows.where(F.col("episode_id") == wanted).count() > 0
    kept = found.select("id", "kind")
    kept.collect()
    metrics = kept._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
    assert metrics.apply("numOutputRows").value() < 400_000 / 10
