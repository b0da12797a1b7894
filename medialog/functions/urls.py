"""Feed, media and artwork addresses. Every path segment is percent-encoded on its own."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

from medialog.functions.text import encode_segment

BASE_URL = r"(?i)\A(https?)://([^/?#\s]+)((?:/[^?#\s]*)?)\z"


def clean_base(url: str | None) -> str | None:
    """Canonical base address given as a plain value, or None when unusable."""
    text = re.sub(r"/+\Z", "", (url or "").strip())
    parts = urlsplit(text)
    if parts.scheme.lower() not in ("http", "https") or not parts.netloc or parts.query or parts.fragment:
        return None
    return f"{parts.scheme.lower()}://{parts.netloc.lower()}{parts.path}"


def base_url(url: Column) -> Column:
    """The same for a column: trailing slashes dropped, scheme and host in lower case."""
    text = F.regexp_replace(F.trim(url), r"/+\z", "")
    canonical = F.concat(
        F.lower(F.regexp_extract(text, BASE_URL, 1)),
        F.lit("://"),
        F.lower(F.regexp_extract(text, BASE_URL, 2)),
        F.regexp_extract(text, BASE_URL, 3),
    )
    return F.when(text.rlike(BASE_URL), canonical)


def join_path(base: Column, *segments: Column) -> Column:
    return F.concat(base, *[F.concat(F.lit("/"), encode_segment(s)) for s in segments])


def _busted(url: Column, buster: Column | None) -> Column:
    if buster is None:
        return url
    return F.when(buster.isNull(), url).otherwise(F.concat(url, F.lit("?v="), encode_segment(buster)))


def item_address(root: Column, *segments: Column, buster: Column | None = None) -> Column:
    """An address below a show's media root."""
    return _busted(join_path(root, *segments), buster)


def feed_url(base: Column, slug: Column, token: Column) -> Column:
    return F.concat(join_path(base, F.lit("feeds"), slug, token), F.lit(".xml"))


def media_url(base: Column, slug: Column, token: Column, episode_id: Column, filename: Column) -> Column:
    return join_path(base, F.lit("media"), slug, token, episode_id, filename)


def media_root(base: Column, slug: Column, token: Column) -> Column:
    """What all media addresses of a show start with."""
    return join_path(base, F.lit("media"), slug, token)


def cover_url(base: Column, slug: Column, token: Column, buster: Column | None = None) -> Column:
    return _busted(join_path(base, F.lit("media"), slug, token, F.lit("cover.jpg")), buster)


def art_url(base: Column, slug: Column, token: Column, episode_id: Column, buster: Column | None = None) -> Column:
    return _busted(join_path(base, F.lit("media"), slug, token, episode_id, F.lit("cover.jpg")), buster)


def iso_instant(ts: Column) -> Column:
    """ISO 8601 UTC text with milliseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
