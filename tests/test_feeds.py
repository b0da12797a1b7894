from __future__ import annotations

import glob
import xml.etree.ElementTree as ET
from datetime import timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F
from test_reconcile import NOW, T0, episodes, frame

from medialog.functions.moments import instant
from medialog.operators import catalogue, feeds
from medialog.plans.feed_refresh import refresh_feeds
from medialog.schemas import SHOWS
from medialog.sources.export import write_feeds

BASE = "https://pods.example.com"
SHOW = dict(title="Show & <Co>", description="D", author_name=" ", author_email="", language="en", itunes_category="Arts",
            itunes_subcategory=None, itunes_type="episodic", explicit=1, cover_filename=None, feed_token="t/k", status="active",
            directory_listing="allowed", created_at=T0, updated_at=T0)
ITUNES = "{http://www.itunes.com/dtds/podcast-1.0.dtd}"
LATER = NOW + timedelta(days=1)


def shows(spark, *rows):
    return frame(spark, SHOWS, SHOW, rows)


def document(lines, show="s"):
    rows = lines.where(F.col("show_id") == show).orderBy(*feeds.document_order()).collect()
    return ET.fromstring("".join(r.line for r in rows)).find("channel")


def test_document(spark):
    eps = episodes(
        spark, dict(id="e1", filename="a b/é.mp3", identity_key="1", title="x\x00 & y", description="<p>]]></p>", pub_date=T0, explicit=0,
                    season=2, episode_type="bonus", art_filename="e1.jpg", art_etag="tag"),
        dict(id="e2", filename="c.mp3", identity_key="2", pub_date=T0 + timedelta(days=2), duration_seconds=None, status="missing"),
        dict(id="e3", filename="d.mp3", identity_key="3", pub_date=LATER), dict(id="e4", filename="f.mp3", identity_key="4", status="removed"),
        dict(id="e5", filename="g.mp3", identity_key="5", status="expired"),
    )
    channel = document(feeds.feed_lines(eps, shows(spark, dict(id="s", slug="my show")), BASE + "/", NOW))
    items = channel.findall("item")
    assert [i.find("guid").text for i in items] == ["e2", "e1"]
    one = items[1]
    assert one.find("title").text == "x & y"
    assert one.find("{http://purl.org/rss/1.0/modules/content/}encoded").text == "<p>]]&gt;</p>"
    assert one.find(ITUNES + "explicit").text == "false" and items[0].find(ITUNES + "explicit").text == "true"
    assert items[0].find(ITUNES + "duration") is None and one.find(ITUNES + "duration").text == "00:01:00"
    assert (one.find(ITUNES + "season").text, one.find(ITUNES + "episodeType").text) == ("2", "bonus")
    assert one.find("enclosure").get("url") == BASE + "/media/my%20show/t%2Fk/e1/a%20b%2F%C3%A9.mp3"
    assert one.find(ITUNES + "image").get("href") == BASE + "/media/my%20show/t%2Fk/e1/cover.jpg?v=tag"
    assert items[0].find(ITUNES + "image") is None
    assert channel.find("title").text == channel.find(ITUNES + "author").text == "Show & <Co>"
    assert channel.find(ITUNES + "owner").find(ITUNES + "email") is None
    assert channel.find(ITUNES + "block") is None and channel.find(ITUNES + "new-feed-url") is None
    assert channel.find("lastBuildDate").text == "Wed, 03 Jan 2024 00:00:00 GMT"


def test_optional_channel_parts(spark):
    dims = shows(spark, dict(id="s", slug="s", author_name="A", author_email=" o@x.y ", directory_listing="blocked", itunes_type="odd",
                             cover_filename="c.png", cover_mtime=T0, itunes_subcategory="Books", language=""))
    channel = document(feeds.feed_lines(episodes(spark), dims, BASE, NOW, announce_move=True))
    assert channel.findall("item") == []
    assert channel.find(ITUNES + "block").text == "Yes"
    assert channel.find(ITUNES + "type").text == "episodic" and channel.find("language").text == "en"
    assert channel.find("{https://podcastindex.org/namespace/1.0}locked").get("owner") == "o@x.y"
    assert channel.find(ITUNES + "category").find(ITUNES + "category").get("text") == "Books"
    assert channel.find(ITUNES + "new-feed-url").text == BASE + "/feeds/s/t%2Fk.xml"
    assert channel.find("image").find("url").text == BASE + "/media/s/t%2Fk/cover.jpg?v=2024-01-01T00%3A00%3A00.000Z"


def test_no_document_without_folder_or_address(spark):
    dims = shows(spark, dict(id="s", slug="s", status="folder_missing"))
    assert feeds.feed_lines(episodes(spark), dims, BASE, NOW).count() == 0
    assert feeds.publishable(shows(spark, dict(id="s", slug="s")), "nonsense").count() == 0


def test_in_feed_equals_items_and_live_rows_split(spark):
    rows = [dict(id=f"e{i}", filename=f"{i}", identity_key=f"{i}", pub_date=NOW + timedelta(seconds=i - 5),
                 status=("active", "missing", "expired", "removed")[i % 4]) for i in range(12)]
    eps = episodes(spark, *rows)
    counts = catalogue.episode_counts(eps, NOW).first()
    assert counts.in_feed == feeds.feed_items(eps, shows(spark, dict(id="s", slug="s")), BASE, NOW).count()
    assert counts.in_feed + counts.scheduled == counts.active + counts.missing


def test_build_date_never_after_now(spark):
    eps = episodes(spark, dict(id="e", filename="a", identity_key="1", updated_at=LATER))
    dims = shows(spark, dict(id="s", slug="s"), dict(id="quiet", slug="q"))
    got = {r.show_id: (r.items, r.last_build_at) for r in feeds.last_build(eps, dims, BASE, NOW).collect()}
    assert got == {"s": (1, NOW), "quiet": (0, T0)}


def test_version_depends_on_content_alone(spark):
    rows = [dict(id=f"e{i}", filename=f"{i}.mp3", identity_key=f"{i}") for i in range(20)]
    dims = shows(spark, dict(id="s", slug="s"))

    def version(eps, parts):
        lines = feeds.feed_lines(eps.repartition(parts), dims, BASE, NOW)
        return feeds.feed_versions(lines).first().version

    one = version(episodes(spark, *rows), 1)
    assert len(one) == 32 and one == version(episodes(spark, *reversed(rows)), 7)
    rows[3]["title"] = "other"
    assert version(episodes(spark, *rows), 1) != one


@pytest.mark.parametrize(
    "version, derived, expected, changed",
    [("v1", "2024-01-09T00:00:00", "2024-01-05T00:00:00", False), ("v2", "2024-01-09T00:00:00.5", "2024-01-09T00:00:00", True),
     ("v2", "2024-01-05T00:00:00", "2024-02-01T00:00:00", True), ("v2", "2024-01-01T00:00:00", "2024-02-01T00:00:00", True)],
)
def test_modified_time_moves_forward_only(spark, version, derived, expected, changed):
    current = spark.range(1).select(F.lit("s").alias("show_id"), F.lit(version).alias("version"), instant(at(derived)).alias("last_build_at"))
    state = spark.range(1).select(F.lit("s").alias("show_id"), F.lit("v1").alias("version"), instant(at("2024-01-05T00:00:00")).alias("modified_at"))
    row = feeds.advance_versions(current, state, NOW).first()
    assert (row.modified_at, row.changed) == (at(expected), changed)


def test_refresh_writes_changed_documents_only(spark, scratch):
    eps = episodes(spark, *[dict(id=f"e{i}", show_id=f"s{i % 2}", filename=f"{i}.mp3", identity_key=f"{i}", pub_date=T0 + timedelta(hours=i)) for i in range(6)])
    dims = shows(spark, dict(id="s0", slug="zero"), dict(id="s1", slug="one"))
    none = spark.createDataFrame([], "show_id STRING, version STRING, modified_at TIMESTAMP")
    state = refresh_feeds(eps, dims, none, BASE, NOW, f"{scratch}/first").cache()
    text = "".join(open(f, encoding="utf8").read() for f in sorted(glob.glob(f"{scratch}/first/slug=zero/*.txt")))
    assert [i.find("guid").text for i in ET.fromstring(text).find("channel").findall("item")] == ["e4", "e2", "e0"]
    moved = eps.withColumn("title", F.when(F.col("id") == "e1", "new").otherwise(F.col("title")))
    after = {r.show_id: r for r in refresh_feeds(moved, dims, state, BASE, NOW, f"{scratch}/second").collect()}
    before = {r.show_id: r for r in state.collect()}
    assert glob.glob(f"{scratch}/second/slug=zero") == [] and glob.glob(f"{scratch}/second/slug=one") != []
    assert after["s0"] == before["s0"] and after["s1"].version != before["s1"].version
    assert after["s1"].modified_at >= before["s1"].modified_at


def test_a_large_document_keeps_its_order_over_files(spark, scratch):
    eps = episodes(spark, dict(id="x", filename="a.mp3", identity_key="1")).drop("id", "pub_date", "show_id")
    many = spark.range(4000).select(
        F.concat(F.lit("e"), "id").alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.pmod(F.hash("id"), F.lit(5000))).alias("pub_date"),
        F.when(F.col("id") % 40 == 0, "t").otherwise("s").alias("show_id"),
    ).crossJoin(eps)
    dims = shows(spark, dict(id="s", slug="big"), dict(id="t", slug="small"))
    lines = feeds.feed_lines(many, dims, BASE, NOW)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    write_feeds(lines, f"{scratch}/out")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for slug, show in (("big", "s"), ("small", "t")):
        parts = sorted(glob.glob(f"{scratch}/out/slug={slug}/*.txt"))
        got = [line for f in parts for line in open(f, encoding="utf8").read().splitlines()]
        rows = lines.where(F.col("show_id") == show).collect()
        want = sorted(rows, key=lambda r: (r.section, -(r.pub_date.timestamp() if r.pub_date else 0), r.episode_id or ""))
        assert got == [r.line for r in want]
    assert len(glob.glob(f"{scratch}/out/slug=big/*.txt")) > 1


def test_items_are_spread_before_they_are_rendered(spark):
    """A file of one row group is read by one task, which should not render all items."""
    lines = feeds.feed_lines(episodes(spark, dict(id="e")), frame(spark, SHOWS, SHOW, [dict(id="s", slug="s")]), BASE, LATER)
    assert "REPARTITION_BY_COL" in lines._jdf.queryExecution().executedPlan().toString()
