"""String expressions: client families, file names, CSV cells, XML text, URL segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Client families, first match wins, matched case-insensitively.
CLIENT_FAMILIES = (
    ("pocketcasts|pocket casts", "Pocket Casts"),
    ("overcast", "Overcast"),
    ("castro", "Castro"),
    ("antennapod", "AntennaPod"),
    ("podcastaddict", "Podcast Addict"),
    ("downcast", "Downcast"),
    ("breaker", "Breaker"),
    ("spotify", "Spotify"),
    ("itunes|apple ?podcasts|itms|applecoremedia|podcasts/", "Apple Podcasts"),
    ("watchos|ios|iphone|ipad", "iOS"),
    ("android", "Android"),
    ("vlc", "VLC"),
    ("curl|wget|httpie", "Command line"),
    ("mozilla|chrome|safari|firefox|edge", "Browser"),
)

# Media types by extension.
AUDIO_TYPES = {
    ".mp3": "audio/mpeg",
    ".m4a": "audio/x-m4a",
    ".aac": "audio/aac",
    ".ogg": "audio/ogg",
    ".opus": "audio/opus",
    ".wav": "audio/wav",
    ".flac": "audio/flac",
}
IMAGE_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
}

# Files that are ordinary clutter beside audio.
CLUTTER_NAMES = ("show.json", "thumbs.db", "desktop.ini", ".ds_store")
CLUTTER_EXTENSIONS = (
    ".jpg", ".jpeg", ".png", ".webp", ".gif", ".txt", ".md", ".json", ".nfo", ".pdf",
    ".srt", ".vtt", ".cue", ".log", ".tmp", ".part", ".crdownload", ".db", ".ini",
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table as a CASE expression, NULL when absent."""
    out = F.lit(None).cast("string")
    for k, v in reversed(table.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def client_family(user_agent: Column) -> Column:
    folded = F.lower(user_agent)
    out = F.lit("Other")
    for pattern, label in reversed(CLIENT_FAMILIES):
        out = F.when(folded.rlike(pattern), label).otherwise(out)
    return F.when(user_agent.isNull() | (user_agent == ""), "Unknown").otherwise(out)


def nocase_key(text: Column) -> Column:
    """Sort key that folds ASCII letters only."""
    return F.translate(text, UPPER, LOWER)


def extension(name: Column) -> Column:
    """Lower-cased last extension with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)\z", 1))


def stem(name: Column) -> Column:
    """Lower-cased name without its last extension; a leading dot is no extension."""
    return F.lower(F.regexp_replace(name, r"(?s)\A(.+)\.[^.]*\z", "$1"))


def audio_type(name: Column) -> Column:
    return lookup(extension(name), AUDIO_TYPES)


def image_type(name: Column) -> Column:
    return lookup(extension(name), IMAGE_TYPES)


def file_class(name: Column) -> Column:
    """audio, image, unsupported (worth a warning) or ignored."""
    ext = extension(name)
    clutter = F.lower(name).isin(*CLUTTER_NAMES) | (ext == "") | ext.isin(*CLUTTER_EXTENSIONS)
    return (
        F.when(audio_type(name).isNotNull(), "audio")
        .when(image_type(name).isNotNull(), "image")
        .when(clutter, "ignored")
        .otherwise("unsupported")
    )


def title_from_filename(name: Column) -> Column:
    """Readable title: no extension, no date prefix, separators to blanks, words capitalised."""
    bare = F.regexp_replace(name, r"\.[^.]+\z", "")
    undated = F.regexp_replace(bare, r"\A\d{4}[-_.]?\d{2}[-_.]?\d{2}[\s\-_.]*", "")
    chosen = F.when(undated == "", bare).otherwise(undated)
    words = F.trim(F.regexp_replace(chosen, r"[\s_\-]+", " "))
    cased = F.transform(
        F.split(words, " "),
        lambda w: F.when(w.rlike(r"\A[A-Z0-9]+\z"), w).otherwise(
            F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))
        ),
    )
    return F.when(words == "", name).otherwise(F.array_join(cased, " "))


def csv_cell(value: Column) -> Column:
    """One RFC 4180 cell; text a spreadsheet would run as a formula gets an apostrophe."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike('[",\r\n]'), quoted).otherwise(safe)


def xml_clean(text: Column) -> Column:
    """Text without the characters XML 1.0 forbids; NULL becomes ''."""
    return F.regexp_replace(
        F.coalesce(text, F.lit("")),
        "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F\\x{FFFE}\\x{FFFF}]",
        "",
    )


def escaped(text: Column) -> Column:
    """Clean text as XML element text."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def xml_text(text: Column) -> Column:
    """Any text as XML element text."""
    return escaped(xml_clean(text))


def xml_attribute(text: Column) -> Column:
    return F.replace(xml_text(text), F.lit('"'), F.lit("&quot;"))


def encode_segment(text: Column) -> Column:
    """Percent-encode one path segment, leaving the marks ``! ' ( ) * ~`` as they are."""
    text = text.cast("string")
    out = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("%27", "'"), ("%21", "!")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    # Most names need no encoding at all.
    return F.when(text.rlike(r"\A[A-Za-z0-9._-]*\z"), text).otherwise(out)


def redact_url(url: Column) -> Column:
    """Hide the credential segment of feed and media paths."""
    feed = r"\A(/feeds/[^/]+/)[^/]+(\.xml)((?:\?.*)?)\z"
    media = r"\A(/media/[^/]+/)[^/]+((?:/.*)?)\z"
    return F.when(url.rlike(feed), F.regexp_replace(url, feed, "$1***$2$3")).otherwise(
        F.regexp_replace(url, media, "$1***$2")
    )


def is_blank(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
