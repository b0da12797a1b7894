"""Key/value settings: upserts, typed view, address moves. An instance column may group them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.functions.moments import instant
from medialog.functions.urls import base_url

# Keys never shown, keys exported, and numeric limits.
SECRET_KEYS = ("session_secret", "admin_password_hash")
EXPORTED_KEYS = (
    "public_base_url",
    "default_author_name",
    "default_author_email",
    "default_language",
    "default_category",
    "default_subcategory",
    "default_explicit",
    "rescan_interval_seconds",
    "missing_grace_seconds",
    "watcher_enabled",
    "session_ttl_hours",
)
RESCAN_LIMITS = (60, 6 * 3600)
GRACE_LIMITS = (60, 30 * 24 * 3600)
SESSION_LIMITS = (1, 24 * 30)
DEFAULT_RESCAN = 300
DEFAULT_GRACE = 24 * 3600
MOVE_WINDOW_DAYS = 60
INSTANCE = "instance_id"
PREVIOUS, PREVIOUS_AT = "previous_public_base_url", "previous_public_base_url_set_at"


def upsert(settings: DataFrame, patch: DataFrame, keys: tuple[str, ...] = (INSTANCE, "key")) -> DataFrame:
    """Write a patch: new and changed values replace, a NULL value deletes."""
    new = patch.select(*keys, F.col("value").alias("new_value"), F.lit(True).alias("patched"))
    value = F.when(F.col("patched"), F.col("new_value")).otherwise(F.col("value"))
    return settings.join(new, list(keys), "full").select(*keys, value.alias("value")).where("value IS NOT NULL")


def seed(settings: DataFrame, defaults: DataFrame, keys: tuple[str, ...] = (INSTANCE, "key")) -> DataFrame:
    """Insert values whose key is absent; blank defaults are no values."""
    fresh = defaults.where("value IS NOT NULL AND value <> ''").join(settings, list(keys), "left_anti")
    return settings.unionByName(fresh.select(*settings.columns))


def visible(settings: DataFrame) -> DataFrame:
    return settings.where(~F.col("key").isin(*SECRET_KEYS))


def _whole(text: Column, fallback: int) -> Column:
    """Leading whole number of a text, else the fallback."""
    return F.coalesce(F.expr(f"try_cast(regexp_extract({text}, '^\\\\s*([+-]?\\\\d+)', 1) AS BIGINT)"), F.lit(fallback))


def _clamp(value: Column, limits: tuple[int, int]) -> Column:
    return F.least(F.lit(limits[1]), F.greatest(F.lit(limits[0]), value))


def _flag(value: Column, fallback: bool) -> Column:
    return F.when(value.isNull(), F.lit(fallback)).otherwise(value.isin("1", "true"))


_READ = (
    "public_base_url", "default_author_name", "default_author_email", "default_language", "default_category",
    "default_subcategory", "default_explicit", "rescan_interval_seconds", "missing_grace_seconds",
    "watcher_enabled", "session_ttl_hours", "setup_complete", "must_change_password", PREVIOUS, PREVIOUS_AT,
)


def wide_settings(settings: DataFrame, by: str = INSTANCE) -> DataFrame:
    """One row per instance, a text column per known key."""
    return settings.groupBy(by).agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in _READ])


def previous_base(now) -> Column:
    """The former address of a wide row, while the move is still to be announced."""
    set_at = F.expr(f"try_cast({PREVIOUS_AT} AS TIMESTAMP)")
    recent = set_at >= instant(now - timedelta(days=MOVE_WINDOW_DAYS))
    return F.when(recent, base_url(F.col(PREVIOUS)))


def typed_settings(settings: DataFrame, now, by: str = INSTANCE) -> DataFrame:
    """Typed, clamped and defaulted settings of every instance; secrets never appear."""
    c = F.col
    return wide_settings(settings, by).select(
        by,
        base_url(c("public_base_url")).alias("public_base_url"),
        previous_base(now).alias("previous_base_url"),
        F.coalesce("default_author_name", F.lit("")).alias("default_author_name"),
        F.coalesce("default_author_email", F.lit("")).alias("default_author_email"),
        F.coalesce("default_language", F.lit("en")).alias("default_language"),
        F.coalesce("default_category", F.lit("Technology")).alias("default_category"),
        "default_subcategory",
        _flag(c("default_explicit"), False).alias("default_explicit"),
        _clamp(_whole("rescan_interval_seconds", DEFAULT_RESCAN), RESCAN_LIMITS).alias("rescan_interval_seconds"),
        _clamp(_whole("missing_grace_seconds", DEFAULT_GRACE), GRACE_LIMITS).alias("missing_grace_seconds"),
        _flag(c("watcher_enabled"), True).alias("watcher_enabled"),
        _clamp(_whole("session_ttl_hours", 12), SESSION_LIMITS).alias("session_ttl_hours"),
        _flag(c("setup_complete"), False).alias("setup_complete"),
        _flag(c("must_change_password"), False).alias("must_change_password"),
    )


def address_moves(settings: DataFrame, patch: DataFrame, now, by: str = INSTANCE) -> DataFrame:
    """Patch rows that record a real change of public address, to be written with the patch.

    A first address is no move, nor is the same one with another spelling.
    """
    def address(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("key") == "public_base_url").select(by, base_url(F.col("value")).alias(name))

    both = address(settings, "before").join(address(patch, "after"), by).where("before <> after")
    stamp = F.lit(now.strftime("%Y-%m-%dT%H:%M:%S.") + f"{now.microsecond // 1000:03d}Z")
    pairs = F.array(
        F.struct(F.lit(PREVIOUS).alias("key"), F.col("before").alias("value")),
        F.struct(F.lit(PREVIOUS_AT).alias("key"), stamp.alias("value")),
    )
    return both.select(by, F.inline(pairs))


def save(settings: DataFrame, patch: DataFrame, now, by: str = INSTANCE) -> DataFrame:
    """Apply a patch, recording address moves with it."""
    moves = address_moves(settings, patch, now, by)
    # What the patch states itself wins over the recorded pair.
    extra = moves.join(patch.select(by, "key"), [by, "key"], "left_anti")
    return upsert(settings, patch.select(by, "key", "value").unionByName(extra), (by, "key"))
