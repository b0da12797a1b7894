"""What a directory would refuse a show for, and the health badge of a show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.functions.taxonomy import is_category
from medialog.functions.text import is_blank
from medialog.operators.artwork import art_problems
from medialog.operators.catalogue import COUNT_COLUMNS
from medialog.operators.rollups import zero_fill

# Image formats a directory accepts; checks that light the badge.
DIRECTORY_FORMATS = ("jpeg", "png")
BADGE_CHECKS = ("folder_present", "artwork_present", "artwork_size", "owner_email", "author_name")


def _check(name: str, level: str, ok: Column, reason: Column | str, applies: Column | None = None) -> Column:
    """One check as a struct; NULL, hence absent, when it does not apply."""
    text = F.lit(reason) if isinstance(reason, str) else reason
    row = F.struct(
        F.lit(name).alias("check_id"),
        F.lit(level).alias("level"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
        F.when(~F.coalesce(ok, F.lit(False)), text).alias("reason"),
    )
    return row if applies is None else F.when(F.coalesce(applies, F.lit(False)), row)


def checks(base_url: str | None) -> Column:
    """The ordered list of checks of a show row that carries its episode counts."""
    c = F.col
    in_feed = c("in_feed") > 0
    has_cover = ~is_blank(c("cover_filename"))
    problems = art_problems(c("cover_width"), c("cover_height"))
    sized = has_cover & (F.coalesce(c("cover_width"), F.lit(0)) > 0) & (F.coalesce(c("cover_height"), F.lit(0)) > 0)
    empty_feed = (
        F.when(c("total") == 0, "no_episodes")
        .when((c("scheduled") > 0) & (c("scheduled") == c("active")), "all_scheduled")
        .otherwise("none_in_feed")
    )
    no_category = F.when(is_blank(c("itunes_category")), "missing").otherwise("not_in_list")
    no_format = F.when(c("cover_format").isNull(), "unreadable").otherwise(F.concat(F.lit("format_"), c("cover_format")))
    return F.array_compact(
        F.array(
            _check("base_url", "error", F.lit(bool(base_url)), "missing"),
            _check("folder_present", "error", c("status") != "folder_missing", "folder_missing"),
            _check("episodes_present", "error", in_feed, empty_feed),
            _check("artwork_present", "error", has_cover, "missing"),
            _check("artwork_format", "error", c("cover_format").isin(*DIRECTORY_FORMATS), no_format, has_cover),
            _check("artwork_size", "error", problems.isNull(), F.array_join(problems, " and "), sized),
            _check("description", "error", ~is_blank(c("description")), "missing"),
            _check("owner_email", "error", ~is_blank(c("author_email")), "missing"),
            _check("category", "error", is_category(c("itunes_category")), no_category),
            _check(
                "directory_listing", "error", F.coalesce(c("directory_listing"), F.lit("allowed")) != "blocked", "blocked"
            ),
            _check("author_name", "warn", ~is_blank(c("author_name")), "missing"),
            _check(
                "episode_durations", "warn", c("in_feed_no_duration") == 0,
                F.concat(c("in_feed_no_duration").cast("string"), F.lit(" of "), c("in_feed").cast("string")), in_feed,
            ),
            _check("episodes_on_disk", "warn", c("missing") == 0, c("missing").cast("string"), in_feed),
        )
    )


def with_counts(shows: DataFrame, counts: DataFrame) -> DataFrame:
    """Show rows with their episode counts, zero where a show has none."""
    dim = shows.withColumnRenamed("id", "show_id")
    return zero_fill(dim, counts, "show_id", COUNT_COLUMNS)


def with_readiness(shows: DataFrame, counts: DataFrame, base_url: str | None) -> DataFrame:
    """Add checks, blocking and advisory counts and ready to every show."""
    out = with_counts(shows, counts).withColumn("checks", checks(base_url))

    def failing(level: str) -> Column:
        return F.size(F.filter("checks", lambda k: ~k["ok"] & (k["level"] == level)))

    return out.withColumns({"blocking": failing("error"), "advisory": failing("warn")}).withColumn(
        "ready", F.col("blocking") == 0
    )


def readiness_checks(shows: DataFrame, counts: DataFrame, base_url: str | None) -> DataFrame:
    """One row per show and check that could be evaluated, in report order."""
    rows = with_readiness(shows, counts, base_url)
    return rows.select("show_id", F.posexplode("checks").alias("position", "k")).select(
        "show_id", "position", "k.check_id", "k.level", "k.ok", "k.reason"
    )


def readiness_summary(shows: DataFrame, counts: DataFrame, base_url: str | None) -> DataFrame:
    return with_readiness(shows, counts, base_url).select("show_id", "ready", "blocking", "advisory")


def badge_warnings() -> Column:
    """Failing checks that the badge shows."""
    return F.transform(
        F.filter("checks", lambda k: ~k["ok"] & k["check_id"].isin(*BADGE_CHECKS)), lambda k: k["check_id"]
    )


def show_health(scan_errors: Column) -> Column:
    """error when the latest scan has errors, warn when a badge check fails, else ok."""
    return (
        F.when(F.coalesce(scan_errors, F.lit(0)) > 0, "error")
        .when(F.size(badge_warnings()) > 0, "warn")
        .otherwise("ok")
    )
