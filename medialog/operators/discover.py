"""Folders against stored shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.functions.moments import instant
from medialog.functions.text import blank_to_null, title_from_filename
from medialog.operators.reconcile import conform, stable_id
from medialog.schemas import SHOWS

# Letters, digits, dots, dashes and underscores, not starting with a dot or dash.
USABLE_SLUG = r"\A[A-Za-z0-9_][A-Za-z0-9._-]*\z"


def discover(folders: DataFrame, shows: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Verdict per folder or show: new, present, returned, vanished, still_missing, ignored, skipped.

    ``folders`` has one column, ``slug``. Hidden folders are left out.
    """
    seen = folders.where(~F.col("slug").startswith(".")).select("slug", F.lit(True).alias("on_disk"))
    known = shows.select("slug", F.col("id").alias("show_id"), "status")
    dead = tombstones.select("slug", F.lit(True).alias("tombstoned"))
    both = seen.join(known, "slug", "full").join(dead, "slug", "left")
    on_disk = F.coalesce("on_disk", F.lit(False))
    usable = F.col("slug").rlike(USABLE_SLUG)
    stored = F.col("show_id").isNotNull()
    missing = F.col("status") == "folder_missing"
    verdict = (
        F.when(on_disk & ~usable, "skipped")
        .when(on_disk & ~stored & F.col("tombstoned"), "ignored")
        .when(on_disk & ~stored, "new")
        .when(on_disk & missing, "returned")
        .when(on_disk, "present")
        .when(missing, "still_missing")
        .otherwise("vanished")
    )
    return both.select("slug", "show_id", verdict.alias("verdict"))


def apply_discovery(shows: DataFrame, verdicts: DataFrame, now) -> DataFrame:
    """Stored shows with their folder status brought up to date; unchanged rows keep their time."""
    marks = verdicts.where(F.col("verdict").isin("vanished", "returned")).select(
        F.col("show_id").alias("id"), "verdict"
    )
    now = instant(now)
    gone, back = F.col("verdict") == "vanished", F.col("verdict") == "returned"
    updates = {
        "status": F.when(gone, "folder_missing").when(back, "active").otherwise(F.col("status")),
        "updated_at": F.when(gone | back, now).otherwise(F.col("updated_at")),
    }
    if "folder_missing_since" in shows.columns:
        updates["folder_missing_since"] = F.when(gone, now).when(back, None).otherwise(F.col("folder_missing_since"))
    return shows.join(marks, "id", "left").withColumns(updates).select(*shows.columns)


def forget_removals(tombstones: DataFrame, wanted: DataFrame) -> DataFrame:
    """Tombstones without the folders (slug) somebody asks to have back."""
    return tombstones.join(wanted.select("slug"), "slug", "left_anti")


def new_shows(
    verdicts: DataFrame, configs: DataFrame, defaults: dict[str, str], now, scan_key: str, token_secret: str
) -> DataFrame:
    """Show rows for newly found folders: config file first, then instance defaults.

    ``configs`` are parsed config files by slug. The feed token is a credential: it is derived
    with a secret that must not be stored beside the data.
    """
    slug = F.col("slug")
    rows = verdicts.where(F.col("verdict") == "new").select("slug").join(configs, "slug", "left")

    def first(column: str, default: str, fallback: str | None = "") -> Column:
        return F.coalesce(F.col(column), blank_to_null(F.lit(defaults.get(default))), F.lit(fallback))

    explicit = F.coalesce("explicit", F.lit(defaults.get("explicit") in ("1", "true")))
    filled = rows.select(
        stable_id(scan_key, F.lit("show"), slug).alias("id"),
        "slug",
        F.coalesce("title", title_from_filename(F.concat(slug, F.lit(".x")))).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        first("author_name", "author_name").alias("author_name"),
        first("author_email", "author_email").alias("author_email"),
        first("language", "language", "en").alias("language"),
        first("category", "category", "Technology").alias("itunes_category"),
        first("subcategory", "subcategory", None).alias("itunes_subcategory"),
        F.coalesce("itunes_type", F.lit("episodic")).alias("itunes_type"),
        explicit.cast("int").alias("explicit"),
        F.sha2(F.concat_ws("|", F.lit(token_secret), F.lit(scan_key), slug), 256).alias("feed_token"),
        F.lit("active").alias("status"),
        F.lit("allowed").alias("directory_listing"),
        instant(now).alias("created_at"),
        instant(now).alias("updated_at"),
    )
    return conform(filled, SHOWS)
