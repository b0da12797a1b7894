"""Feed documents: items, build dates, rendered lines, versions.

A document is kept as ordered lines (head, one line per item, tail) and never gathered into
one value: one show may hold a third of all episodes. Its version is a digest that adds up
over item lines, so it too is computed with partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.functions import urls
from medialog.functions.moments import feed_duration, instant, rfc2822
from medialog.functions.text import blank_to_null, escaped, is_blank, xml_attribute, xml_clean, xml_text
from medialog.operators.catalogue import feed_eligible
from medialog.operators.joins import lookup_join, spread

GENERATOR = "medialog"
# The namespaces of a feed.
NAMESPACES = (
    ("itunes", "http://www.itunes.com/dtds/podcast-1.0.dtd"),
    ("podcast", "https://podcastindex.org/namespace/1.0"),
    ("content", "http://purl.org/rss/1.0/modules/content/"),
    ("atom", "http://www.w3.org/2005/Atom"),
)
def publishable(shows: DataFrame, base_url: str | None) -> DataFrame:
    """Shows that have a feed: folder present and a base address known."""
    if urls.clean_base(base_url) is None:
        return shows.limit(0)
    return shows.where(F.col("status") != "folder_missing")


def _truth(flag: Column) -> Column:
    return F.when(flag == 1, "true").otherwise("false")


def show_addresses(shows: DataFrame, base_url: str) -> DataFrame:
    """Per published show what its items share, computed once per show."""
    base = F.lit(urls.clean_base(base_url))
    cover = urls.cover_url(base, F.col("slug"), F.col("feed_token"), urls.iso_instant(F.col("cover_mtime")))
    return publishable(shows, base_url).select(
        F.col("id").alias("show_id"),
        F.struct(
            "slug",
            "explicit",
            urls.media_root(base, F.col("slug"), F.col("feed_token")).alias("root"),
            F.when(~is_blank(F.col("cover_filename")), cover).alias("cover_url"),
        ).alias("show"),
    )


def feed_items(episodes: DataFrame, shows: DataFrame, base_url: str, now) -> DataFrame:
    """One row per item of every published feed, all fields resolved."""
    # Items are spread before they are rendered, which is most of the work.
    rows = lookup_join(
        spread(episodes.where(feed_eligible(now)), "id"), show_addresses(shows, base_url), ["show_id"], ["id"], "inner"
    )
    show = F.col("show")
    own_art = urls.item_address(show["root"], F.col("id"), F.lit("cover.jpg"), buster=F.col("art_etag"))
    return rows.select(
        "show_id",
        show["slug"].alias("slug"),
        F.col("id").alias("episode_id"),
        xml_clean(F.col("title")).alias("title"),
        xml_clean(F.col("description")).alias("description"),
        "pub_date",
        "created_at",
        "updated_at",
        feed_duration(F.col("duration_seconds")).alias("duration"),
        _truth(F.coalesce("explicit", show["explicit"])).alias("explicit"),
        "season",
        "episode_number",
        F.when(F.col("episode_type").isin("trailer", "bonus"), F.col("episode_type")).otherwise("full").alias("episode_type"),
        F.when(~is_blank(F.col("art_filename")), own_art).otherwise(show["cover_url"]).alias("image_url"),
        urls.item_address(show["root"], F.col("id"), F.col("filename")).alias("enclosure_url"),
        F.coalesce("file_size_bytes", F.lit(0)).cast("bigint").alias("enclosure_length"),
        F.col("mime_type").alias("enclosure_type"),
    )


def order_items(items: DataFrame) -> DataFrame:
    return items.orderBy("show_id", F.desc("pub_date"), F.desc("created_at"), "episode_id")


def last_build(episodes: DataFrame, shows: DataFrame, base_url: str, now) -> DataFrame:
    """Per published show: its latest change among show, item dates and updates, never after now.

    The dates come from the episodes alone, which are counted before they meet the shows.
    """
    newest = episodes.where(feed_eligible(now)).groupBy("show_id").agg(
        F.max(F.greatest("pub_date", "updated_at")).alias("newest"), F.count("*").alias("items")
    )
    dims = publishable(shows, base_url).select(F.col("id").alias("show_id"), F.col("updated_at").alias("show_updated_at"))
    now = instant(now)
    latest = F.coalesce(F.greatest("newest", "show_updated_at"), now)
    return dims.join(newest, "show_id", "left").select(
        "show_id", F.coalesce("items", F.lit(0)).alias("items"), F.least(latest, now).alias("last_build_at")
    )


def _element(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))


def _empty(name: str, **attributes: Column) -> Column:
    """An element of clean attribute values, such as addresses."""
    quoted = {k: F.replace(escaped(v), F.lit('"'), F.lit("&quot;")) for k, v in attributes.items()}
    parts = [F.concat(F.lit(f' {k}="'), v, F.lit('"')) for k, v in quoted.items()]
    return F.concat(F.lit(f"<{name}"), *parts, F.lit("/>"))


def _join(*parts: Column) -> Column:
    """Concatenation that leaves absent elements out."""
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def item_xml() -> Column:
    """The item element of a feed_items row."""
    c = F.col
    body = F.replace(c("description"), F.lit("]]>"), F.lit("]]&gt;"))
    return _join(
        F.lit("<item>"),
        _element("title", escaped(c("title"))),
        _element("description", escaped(c("description"))),
        F.when(c("description") != "", _element("content:encoded", F.concat(F.lit("<![CDATA["), body, F.lit("]]>")))),
        F.concat(F.lit('<guid isPermaLink="false">'), escaped(c("episode_id")), F.lit("</guid>")),
        _element("pubDate", rfc2822(c("pub_date"))),
        F.when(c("duration").isNotNull(), _element("itunes:duration", c("duration"))),
        _element("itunes:explicit", c("explicit")),
        F.when(c("season").isNotNull(), _element("itunes:season", c("season").cast("string"))),
        F.when(c("episode_number").isNotNull(), _element("itunes:episode", c("episode_number").cast("string"))),
        _element("itunes:episodeType", c("episode_type")),
        F.when(c("image_url").isNotNull(), _empty("itunes:image", href=c("image_url"))),
        _empty("enclosure", url=c("enclosure_url"), length=c("enclosure_length").cast("string"), type=c("enclosure_type")),
        F.lit("</item>"),
    )


def head_xml(base_url: str, announce_move: bool = False) -> Column:
    """Everything before the items, from a show row with last_build_at."""
    c = F.col
    base = F.lit(urls.clean_base(base_url))
    author = xml_text(F.coalesce(blank_to_null(c("author_name")), c("title")))
    email = blank_to_null(c("author_email"))
    cover = urls.cover_url(base, c("slug"), c("feed_token"), urls.iso_instant(c("cover_mtime")))
    has_cover = ~is_blank(c("cover_filename"))
    feed = urls.feed_url(base, c("slug"), c("feed_token"))
    sub = F.when(~is_blank(c("itunes_subcategory")), _empty("itunes:category", text=xml_clean(c("itunes_subcategory"))))
    category = F.concat(
        F.lit('<itunes:category text="'), xml_attribute(c("itunes_category")), F.lit('">'),
        F.coalesce(sub, F.lit("")), F.lit("</itunes:category>"),
    )
    locked_owner = F.when(email.isNotNull(), F.concat(F.lit(' owner="'), xml_attribute(email), F.lit('"')))
    spaces = "".join(f' xmlns:{name}="{uri}"' for name, uri in NAMESPACES)
    return _join(
        F.lit(f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"{spaces}><channel>'),
        _element("title", xml_text(c("title"))),
        _element("link", xml_text(base)),
        _element("description", xml_text(c("description"))),
        _element("language", xml_text(F.coalesce(F.nullif(c("language"), F.lit("")), F.lit("en")))),
        _element("itunes:author", author),
        _element("itunes:summary", xml_text(c("description"))),
        F.lit("<itunes:owner>"),
        _element("itunes:name", author),
        F.when(email.isNotNull(), _element("itunes:email", xml_text(email))),
        F.lit("</itunes:owner>"),
        category,
        _element("itunes:explicit", _truth(c("explicit"))),
        _element("itunes:type", F.when(c("itunes_type") == "serial", "serial").otherwise("episodic")),
        F.when(c("directory_listing") == "blocked", F.lit("<itunes:block>Yes</itunes:block>")),
        F.when(
            has_cover,
            F.concat(
                _empty("itunes:image", href=cover),
                F.lit("<image>"),
                _element("url", xml_text(cover)),
                _element("title", xml_text(c("title"))),
                _element("link", xml_text(base)),
                F.lit("</image>"),
            ),
        ),
        F.lit("<podcast:locked"), locked_owner, F.lit(">yes</podcast:locked>"),
        _element("podcast:guid", xml_text(c("id"))),
        F.lit(f"<generator>{GENERATOR}</generator>"),
        _element("lastBuildDate", rfc2822(c("last_build_at"))),
        _empty("atom:link", href=feed, rel=F.lit("self"), type=F.lit("application/rss+xml")),
        _element("itunes:new-feed-url", xml_text(feed)) if announce_move else F.lit(""),
    )


TAIL = "</channel></rss>"
HEAD_SECTION, ITEM_SECTION, TAIL_SECTION = 0, 1, 2


def feed_lines(
    episodes: DataFrame, shows: DataFrame, base_url: str, now, announce_move: bool = False
) -> DataFrame:
    """The documents as lines: show_id, slug, section, pub_date, created_at, episode_id, line.

    A document is its lines ordered by section, pub_date and created_at descending, then
    episode_id.
    """
    items = feed_items(episodes, shows, base_url, now)
    built = last_build(episodes, shows, base_url, now)
    heads = publishable(shows, base_url).join(built.select(F.col("show_id").alias("id"), "last_build_at"), "id")
    none = {"pub_date": F.lit(None).cast("timestamp"), "created_at": F.lit(None).cast("timestamp"),
            "episode_id": F.lit(None).cast("string")}

    def section(n: int, line: Column) -> Column:
        return F.struct(F.lit(n).alias("section"), line.alias("line"))

    frames = heads.select(
        F.col("id").alias("show_id"),
        "slug",
        F.inline(F.array(section(HEAD_SECTION, head_xml(base_url, announce_move)), section(TAIL_SECTION, F.lit(TAIL)))),
    ).withColumns(none)
    body = items.select(
        "show_id", "slug", F.lit(ITEM_SECTION).alias("section"), item_xml().alias("line"), "pub_date", "created_at", "episode_id"
    )
    return frames.unionByName(body)


def document_order() -> list[Column]:
    """Order of lines. It starts with the folder column, so that a partitioned write keeps it."""
    return [F.col("slug"), F.col("section"), F.desc("pub_date"), F.desc("created_at"), F.col("episode_id")]


def feed_versions(lines: DataFrame) -> DataFrame:
    """Per show a 32-digit content version, with line count and size.

    Item order follows from item content, so a sum of line digests identifies the document.
    Each digest is cut into four 60-bit numbers that are summed and XOR-ed.
    """
    digests = lines.select("show_id", F.octet_length("line").alias("size"), F.sha2("line", 256).alias("digest"))
    cuts = {f"p{i}": F.conv(F.substring("digest", 1 + 15 * i, 15), 16, 10).cast("bigint") for i in range(4)}
    totals = digests.select("show_id", "size", *[c.alias(n) for n, c in cuts.items()]).groupBy("show_id").agg(
        F.count("*").alias("lines"),
        F.sum("size").alias("bytes"),
        *[F.sum(F.col(n).cast("decimal(20,0)")).alias(f"sum_{n}") for n in cuts],
        *[F.bit_xor(n).alias(f"xor_{n}") for n in cuts],
    )
    parts = ["lines", *[f"sum_{n}" for n in cuts], *[f"xor_{n}" for n in cuts]]
    version = F.substring(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256), 1, 32)
    return totals.select("show_id", "lines", "bytes", version.alias("version"))


def advance_versions(current: DataFrame, state: DataFrame, now) -> DataFrame:
    """Move each show's modified time forward only.

    ``current`` has show_id, version, last_build_at; ``state`` show_id, version, modified_at.
    Same version keeps its time; a changed one whose build date did not advance gets now.
    """
    old = state.select("show_id", F.col("version").alias("old_version"), F.col("modified_at").alias("old_at"))
    derived, old_at = F.col("last_build_at"), F.col("old_at")
    at = (
        F.when(F.col("old_version") == F.col("version"), old_at)
        .when(derived <= old_at, instant(now))
        .otherwise(derived)
    )
    return current.join(old, "show_id", "left").select(
        "show_id",
        "version",
        F.date_trunc("second", at).alias("modified_at"),
        (~F.col("old_version").eqNullSafe(F.col("version"))).alias("changed"),
    )
