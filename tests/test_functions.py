from __future__ import annotations

import urllib.parse

import pytest
from conftest import at
from pyspark.sql import functions as F

from medialog.functions import moments, numbers, taxonomy, text, urls


def values(spark, rows, column):
    """The expression over a one-column frame ``x``."""
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i INT, x STRING")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_client_families(spark):
    agents = {
        "Pocket Casts/7.5 (iPhone; iOS 18.2)": "Pocket Casts",
        "PocketCasts/1.0": "Pocket Casts",
        "Overcast/2024 (+http://overcast.fm/; iOS podcast app)": "Overcast",
        "AntennaPod/3.4.0": "AntennaPod",
        "Podcasts/1580.3 CFNetwork": "Apple Podcasts",
        "AppleCoreMedia/1.0.0 (iPhone; U; CPU OS 18_2)": "Apple Podcasts",
        "SomeApp/1 (iPad)": "iOS",
        "curl/8.4.0": "Command line",
        "Mozilla/5.0 (X11; Linux x86_64) Chrome/120": "Browser",
        "TotallyNew/1.0": "Other",
        "": "Unknown",
        None: "Unknown",
    }
    assert values(spark, list(agents), text.client_family) == list(agents.values())


def test_file_names(spark):
    names = ["a.MP3", "b.m4a", ".mp3", "noext", "x.tar.wav", "c.wma", "Thumbs.db", "d.JPEG", "show.json", "e.opus "]
    assert values(spark, names, text.file_class) == [
        "audio", "audio", "audio", "ignored", "audio", "unsupported", "ignored", "image", "ignored", "unsupported",
    ]
    assert values(spark, ["Ep.One.MP3", ".mp3", "noext"], text.stem) == ["ep.one", ".mp3", "noext"]


def test_titles(spark):
    cases = {
        "2026-08-07-episode-one.m4a": "Episode One",
        "20260807_the_BBC_hour.mp3": "The BBC Hour",
        "2026-08-07.mp3": "2026 08 07",
        "already Fine.mp3": "Already Fine",
        "---.mp3": "---.mp3",
    }
    assert values(spark, list(cases), text.title_from_filename) == list(cases.values())


def test_csv_cells(spark):
    cases = {
        None: "", "plain": "plain", 'say "hi"': '"say ""hi"""', "a,b": '"a,b"', "two\nlines": '"two\nlines"',
        "=1+1": "'=1+1", "-dash": "'-dash", "@x,y": "\"'@x,y\"", "\tt": "'\tt",
    }
    assert values(spark, list(cases), text.csv_cell) == list(cases.values())


def test_segments_are_encoded_like_a_browser(spark):
    raw = ["a b*(é)~'!", "50% off/“q” 🎧.mp3", "plain-._name", "a+b&c=d?#"]
    assert values(spark, raw, text.encode_segment) == [urllib.parse.quote(r, safe="-._~!*'()") for r in raw]


def test_redaction(spark):
    cases = {
        "/feeds/show/TOKEN.xml": "/feeds/show/***.xml",
        "/feeds/show/TOKEN.xml?x=1": "/feeds/show/***.xml?x=1",
        "/media/show/TOKEN/ep/a.mp3": "/media/show/***/ep/a.mp3",
        "/media/show/TOKEN": "/media/show/***",
        "/feeds/show/other": "/feeds/show/other",
        "/health": "/health",
    }
    assert values(spark, list(cases), text.redact_url) == list(cases.values())


def test_xml_text_drops_what_xml_forbids(spark):
    assert values(spark, ["a\x00b\x0bc\x9fd￾", "<&>", None], text.xml_text) == ["abcd", "&lt;&amp;&gt;", ""]


def test_base_urls(spark):
    cases = {
        " HTTPS://Pods.Example.com/x// ": "https://pods.example.com/x",
        "http://a.b": "http://a.b",
        "ftp://a.b": None, "nonsense": None, "": None, "http://a.b/?q=1": None, "http://a.b/#f": None,
    }
    assert values(spark, list(cases), urls.base_url) == list(cases.values())
    assert [urls.clean_base(c) for c in cases] == list(cases.values())


def test_durations_and_dates(spark):
    rows = spark.createDataFrame([(0,), (59,), (3599,), (3600,), (360000,), (None,)], "s INT")
    got = rows.select(moments.feed_duration(F.col("s")), moments.short_duration(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [
        ("00:00:00", "0:00"), ("00:00:59", "0:59"), ("00:59:59", "59:59"), ("01:00:00", "1:00:00"),
        ("100:00:00", "100:00:00"), (None, None),
    ]
    day = spark.range(1).select(moments.rfc2822(moments.instant(at("2026-08-09T12:00:00")))).first()[0]
    assert day == "Sun, 09 Aug 2026 12:00:00 GMT"


@pytest.mark.parametrize(
    "seconds, words",
    [(0, "just now"), (-30, "30 seconds ago"), (60, "in 1 minute"), (-7200, "2 hours ago"), (-86400 * 3, "3 days ago"),
     (86400 * 60, "in 2 months"), (-86400 * 365 * 2, "2 years ago")],
)
def test_relative_times(spark, seconds, words):
    now = at("2024-06-01T00:00:00")
    ts = moments.instant(now) + F.expr(f"INTERVAL {seconds} SECOND")
    assert spark.range(1).select(moments.relative_time(ts, moments.instant(now))).first()[0] == words


def test_local_input_round_trip(spark):
    got = spark.range(1).select(
        moments.parse_local_input(F.lit("2026-07-01T09:30"), "Europe/London").cast("string"),
        moments.parse_local_input(F.lit("2026-01-01 09:30"), "Europe/London").cast("string"),
        moments.parse_local_input(F.lit("2026-01-01T09:30:00Z"), "Europe/London").cast("string"),
        moments.parse_local_input(F.lit("soon"), "Europe/London").cast("string"),
        moments.local_input(moments.instant(at("2026-07-01T08:30:00")), "Europe/London"),
    ).first()
    assert list(got) == ["2026-07-01 08:30:00", "2026-01-01 09:30:00", "2026-01-01 09:30:00", None, "2026-07-01T09:30"]


def test_sizes_and_intervals(spark):
    rows = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (5 * 1024**3,), (3 * 1024**5,), (None,)], "n BIGINT")
    assert [r[0] for r in rows.select(numbers.format_bytes(F.col("n"))).collect()] == [
        "0 B", "1023 B", "1.0 KB", "1.5 KB", "5.0 GB", "3072.0 TB", "—",
    ]
    rows = spark.createDataFrame([(60,), (300,), (7200,), (9000,)], "n BIGINT")
    assert [r[0] for r in rows.select(numbers.interval_text(F.col("n"))).collect()] == [
        "60 sec", "5 min", "2 h", "2.5 h",
    ]


def test_changes(spark):
    rows = spark.createDataFrame([(20, 10), (0, 10), (5, 5), (5, 0), (5, None)], "c BIGINT, p BIGINT")
    change = numbers.change_between(F.col("c"), F.col("p"))
    got = rows.select(change.alias("k"), numbers.change_text(change).alias("t")).collect()
    assert [(r.k.absolute, r.k.percent, r.k.direction) if r.k else None for r in got] == [
        (10, 100.0, "up"), (-10, -100.0, "down"), (0, 0.0, "flat"), (5, None, "up"), None,
    ]
    assert [tuple(r.t) if r.t else None for r in got] == [
        ("good", "+100% vs the previous period"), ("bad", "−100% vs the previous period"),
        ("flat", "no change vs the previous period"), ("good", "+5 vs the previous period"), None,
    ]


def test_taxonomy(spark):
    assert len(taxonomy.CATEGORIES) == 19
    got = values(spark, ["Arts", "arts", "", None, "TV & Film"], taxonomy.is_category)
    assert got == [True, False, False, False, True]
    rows = spark.createDataFrame([("Arts", "Books"), ("Arts", "Golf"), ("Arts", ""), ("Tech", ""), ("History", None)], "c STRING, s STRING")
    assert [r[0] for r in rows.select(taxonomy.is_subcategory(F.col("c"), F.col("s"))).collect()] == [True, False, True, False, True]


def test_category_matching(spark):
    from medialog.operators.categories import match_category

    cases = {
        "Arts": ("Arts", None),
        "Arts → Books": ("Arts", "Books"),
        "ARTS>books": ("Arts", "Books"),
        "Books": ("Arts", "Books"),
        "SELF—IMPROVEMENT": ("Education", "Self-Improvement"),
        "health and fitness / yoga": ("Health & Fitness", None),
        "Leisure: Golf": ("Sports", "Golf"),
        "Ｎｅｗｓ": ("News", None),
        "Stand-Up": ("Comedy", "Stand-Up"),
        "unheard of": (None, None),
        "": (None, None),
        None: (None, None),
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, raw STRING")
    got = match_category(df, "raw").orderBy("i").collect()
    assert [(r.category, r.subcategory) for r in got] == list(cases.values())
