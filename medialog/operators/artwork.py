"""Covers, sidecar images and the artwork columns of an episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.functions.moments import instant
from medialog.functions.text import audio_type, extension, image_type, lookup, stem

# Cover names and sidecar extensions, best first; artwork size limits.
COVER_NAMES = ("cover.jpg", "cover.jpeg", "cover.png", "cover.webp", "folder.jpg", "artwork.jpg")
SIDECAR_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
MIN_PX = 1400
MAX_PX = 3000

ART_COLUMNS = (
    "art_source",
    "art_filename",
    "art_sidecar_name",
    "art_sidecar_mtime",
    "art_width",
    "art_height",
    "art_etag",
)


def _rank(value: Column, order: tuple[str, ...]) -> Column:
    return lookup(value, {name: str(i) for i, name in enumerate(order)}).cast("int")


def cover_pick(listing: DataFrame) -> DataFrame:
    """The cover file of each show: first known name present, in any case."""
    ranked = listing.withColumn("rank", _rank(F.lower("filename"), COVER_NAMES)).where("rank IS NOT NULL")
    return ranked.groupBy("show_id").agg(
        F.min_by("filename", F.struct("rank", "filename")).alias("cover_filename")
    )


def apply_covers(shows: DataFrame, listing: DataFrame, scanned: DataFrame, now) -> DataFrame:
    """Shows with the cover file that the listing has for them.

    Only shows in ``scanned`` (show_id) are judged. A cover that is another file, or the same file
    changed, loses its measures until the image is read again; an unchanged one keeps its row as it is.
    """
    picks = cover_pick(listing)
    times = listing.select("show_id", F.col("filename").alias("cover_filename"), F.col("mtime").alias("cover_mtime"))
    found = scanned.join(picks, "show_id", "left").join(times, ["show_id", "cover_filename"], "left")
    named = found.select(F.col("show_id").alias("id"), F.lit(True).alias("judged"), F.col("cover_filename").alias("__file"), F.col("cover_mtime").alias("__time"))
    same = F.col("cover_filename").eqNullSafe(F.col("__file")) & F.col("cover_mtime").eqNullSafe(F.col("__time"))
    moved = F.coalesce("judged", F.lit(False)) & ~same
    suffix = F.regexp_replace(extension(F.col("__file")), r"^\.", "")
    kind = F.when(suffix == "jpg", "jpeg").otherwise(suffix)
    updates = {
        "cover_filename": F.col("__file"),
        "cover_mtime": F.col("__time"),
        "cover_format": kind,
        "cover_width": F.lit(None).cast("int"),
        "cover_height": F.lit(None).cast("int"),
        "updated_at": instant(now),
    }
    joined = shows.join(named, "id", "left").withColumn("__moved", moved)
    return joined.select(*[F.when(F.col("__moved"), updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c) for c in shows.columns])


def sidecar_art(listing: DataFrame) -> DataFrame:
    """Audio file to the image beside it with the same stem, in any case, best extension."""
    images = (
        listing.where(image_type(F.col("filename")).isNotNull())
        .groupBy("show_id", stem(F.col("filename")).alias("stem"))
        .agg(
            F.min_by(
                F.struct("filename", "mtime"),
                F.struct(_rank(extension(F.col("filename")), SIDECAR_EXTENSIONS), F.col("filename")),
            ).alias("art")
        )
    )
    audio = listing.where(audio_type(F.col("filename")).isNotNull()).select(
        "show_id", "filename", stem(F.col("filename")).alias("stem")
    )
    return audio.join(images, ["show_id", "stem"]).select(
        "show_id",
        "filename",
        F.col("art.filename").alias("sidecar_name"),
        F.col("art.mtime").alias("sidecar_mtime"),
    )


def choose_art(episodes: DataFrame, sidecars: DataFrame, images: DataFrame) -> DataFrame:
    """Desired artwork columns per episode: sidecar image, else embedded, else none.

    ``images`` holds stored pictures: show_id, filename (of the audio or the sidecar), source,
    stored_name, width, height, etag. Removed episodes are left as they are.
    """
    embedded = images.where(F.col("source") == "embedded").select(
        "show_id", "filename", F.struct("stored_name", "width", "height", "etag").alias("embedded")
    )
    beside = images.where(F.col("source") == "sidecar").select(
        "show_id",
        F.col("filename").alias("sidecar_name"),
        F.struct("stored_name", "width", "height", "etag").alias("beside"),
    )
    wanted = (
        episodes.where(F.col("status") != "removed")
        .select("id", "show_id", "filename")
        .join(sidecars, ["show_id", "filename"], "left")
        .join(beside, ["show_id", "sidecar_name"], "left")
        .join(embedded, ["show_id", "filename"], "left")
    )
    from_side = F.col("beside").isNotNull()
    # A sidecar that could not be stored leaves the episode unchanged, so it yields no row.
    wanted = wanted.where(F.col("sidecar_name").isNull() | from_side)
    pick = F.when(from_side, F.col("beside")).otherwise(F.col("embedded"))
    return wanted.select(
        "id",
        F.when(from_side, "sidecar").when(F.col("embedded").isNotNull(), "embedded").alias("art_source"),
        pick["stored_name"].alias("art_filename"),
        F.when(from_side, F.col("sidecar_name")).alias("art_sidecar_name"),
        F.when(from_side, F.col("sidecar_mtime")).alias("art_sidecar_mtime"),
        pick["width"].alias("art_width"),
        pick["height"].alias("art_height"),
        pick["etag"].alias("art_etag"),
    )


def art_changes(episodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Episodes whose artwork columns differ, NULL-safely, with the names that differ."""
    stored = episodes.select("id", *[F.col(c).alias(f"old_{c}") for c in ART_COLUMNS])
    names = F.array_compact(
        F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"old_{c}")), F.lit(c)) for c in ART_COLUMNS])
    )
    return (
        stored.join(wanted, "id")
        .withColumn("changed", names)
        .where(F.size("changed") > 0)
        .select("id", *ART_COLUMNS, "changed")
    )


def apply_art(episodes: DataFrame, changes: DataFrame, now) -> DataFrame:
    """New snapshot: only changed rows move, so their update time moves alone."""
    fresh = changes.select("id", F.struct(*ART_COLUMNS).alias("art"))
    out = episodes.join(fresh, "id", "left")
    moved = F.col("art").isNotNull()
    updates = {c: F.when(moved, F.col("art")[c]).otherwise(F.col(c)) for c in ART_COLUMNS}
    updates["updated_at"] = F.when(moved, instant(now)).otherwise(F.col("updated_at"))
    return out.withColumns(updates).select(*episodes.columns)


def art_problems(width: Column, height: Column) -> Column:
    """Sentence parts on what a directory would refuse; NULL when fine or unknown."""
    square = width == height
    small = (width < MIN_PX) | (height < MIN_PX)
    large = (width > MAX_PX) | (height > MAX_PX)
    parts = F.array_compact(
        F.array(
            F.when(~square, F.lit("not square")),
            F.when(small, F.lit(f"smaller than {MIN_PX}px")).when(large, F.lit(f"larger than {MAX_PX}px")),
        )
    )
    known = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    return F.when(known & (F.size(parts) > 0), parts)
