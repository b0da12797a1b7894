"""Bulk edits of show and episode metadata, checked field by field."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.functions.moments import instant, parse_local_input
from medialog.functions.taxonomy import is_category, is_subcategory
from medialog.functions.text import blank_to_null, is_blank
from medialog.schemas import DIRECTORY_LISTINGS, EPISODE_TYPES, SHOW_TYPES

# A name, one @, and a domain of two labels or more; no white space.
EMAIL = r"\A(?!.*\s)[^@]+@(?:[^@.]+\.)+[^@.]+\z"
LANGUAGE = r"\A[a-z]{2}(-[a-z]{2})?\z"
INHERIT = "inherit"


@dataclass(frozen=True)
class Rule:
    """A patch column: the target column, its checked value, and the complaint when invalid.

    ``value`` and ``valid`` are functions of the raw patch column. A NULL raw value leaves the
    target alone; an empty text is a value.
    """

    source: str
    target: str
    value: Callable[[Column], Column]
    valid: Callable[[Column], Column] = lambda raw: F.lit(True)
    complaint: str = ""
    #: Characters that the trimmed text may have; a longer one is refused, never cut.
    most: int | None = None

    def error(self, raw: Column) -> Column:
        """The complaint about a raw value, NULL when there is none."""
        bad = F.when(~F.coalesce(self.valid(raw), F.lit(False)), F.lit(self.complaint))
        if self.most is not None:
            bad = F.when(F.length(F.trim(raw)) > self.most, F.lit(f"Use at most {self.most} characters.")).otherwise(bad)
        return F.when(raw.isNotNull(), bad)


def _folded(raw: Column) -> Column:
    return F.lower(F.trim(raw))


def _is_whole(raw: Column) -> Column:
    return is_blank(raw) | F.trim(raw).rlike(r"\A\+?\d+")


def _whole(raw: Column) -> Column:
    return F.regexp_extract(F.trim(raw), r"\A\+?(\d+)", 1).try_cast("int")


def _true(raw: Column, *words: str) -> Column:
    return F.when(raw.isin(*words), 1).otherwise(0)


def show_rules() -> list[Rule]:
    """Rules of show metadata. Text comes from outside, so allowed values are checked here."""
    category = F.when(
        F.col("patch.category").isNotNull() & is_category(F.trim("patch.category")), F.trim("patch.category")
    ).otherwise(F.col("itunes_category"))
    return [
        Rule("title", "title", F.trim, lambda r: ~is_blank(r), "A show needs a name.", 300),
        Rule("description", "description", F.trim, most=8000),
        Rule("author_name", "author_name", F.trim, most=200),
        Rule(
            "author_email", "author_email", F.trim,
            lambda r: is_blank(r) | F.trim(r).rlike(EMAIL), "This is not an email address.", 200,
        ),
        Rule(
            "language", "language", lambda r: F.coalesce(F.nullif(_folded(r), F.lit("")), F.lit("en")),
            lambda r: is_blank(r) | _folded(r).rlike(LANGUAGE), "Use a code such as en or en-gb.",
        ),
        Rule(
            "category", "itunes_category", lambda r: F.trim(r), lambda r: is_category(F.trim(r)),
            "Choose a listed category.",
        ),
        Rule(
            "subcategory", "itunes_subcategory", blank_to_null,
            lambda r: is_blank(r) | is_subcategory(category, F.trim(r)), "Choose a subcategory of the category.",
        ),
        Rule("explicit", "explicit", lambda r: _true(r, "1", "true", "on")),
        Rule(
            "itunes_type", "itunes_type", _folded, lambda r: _folded(r).isin(*SHOW_TYPES), "Choose episodic or serial."
        ),
        Rule(
            "directory_listing", "directory_listing", _folded, lambda r: _folded(r).isin(*DIRECTORY_LISTINGS),
            "Choose allowed or blocked.",
        ),
    ]


def episode_rules(zone: str) -> list[Rule]:
    own_title = lambda r: F.when(F.trim(r).eqNullSafe(F.col("tag_title")), 0).otherwise(1)
    has_title = lambda r: ~is_blank(r)
    date = lambda r: parse_local_input(r, zone)
    has_date = lambda r: date(r).isNotNull()
    inherit = lambda r: is_blank(r) | (r == INHERIT)
    return [
        Rule("title", "title", F.trim, has_title, "An episode needs a title.", 400),
        # A title typed by hand is locked against the scanner.
        Rule("title", "title_is_custom", own_title, has_title, "An episode needs a title.", 400),
        Rule("description", "description", F.trim, most=20000),
        Rule("season", "season", _whole, _is_whole, "Season must be a whole number."),
        Rule("episode_number", "episode_number", _whole, _is_whole, "Episode number must be a whole number."),
        Rule(
            "episode_type", "episode_type", _folded, lambda r: _folded(r).isin(*EPISODE_TYPES),
            "Choose full, trailer or bonus.",
        ),
        Rule("explicit", "explicit", lambda r: F.when(~inherit(r), _true(r, "1", "true", "yes"))),
        Rule("pub_date", "pub_date", date, has_date, "This is not a date."),
        Rule("pub_date", "pub_date_is_custom", lambda r: F.lit(1), has_date, "This is not a date."),
    ]


def apply_patches(table: DataFrame, patches: DataFrame, rules: list[Rule], now) -> DataFrame:
    """The table with patches (id and text columns) applied, and an ``errors`` map per row.

    A row with any invalid field keeps all its values. Patches hold one row per id.
    """
    given = [c for c in patches.columns if c != "id"]
    rules = [r for r in rules if r.source in given]
    out = table.join(patches.select("id", F.struct(*given).alias("patch")), "id", "left")

    def raw(rule: Rule) -> Column:
        return F.col(f"patch.{rule.source}")

    complaints = {}
    for rule in rules:
        error = rule.error(raw(rule))
        complaints[rule.source] = F.when(error.isNotNull(), F.struct(F.lit(rule.source), error))
    errors = F.map_from_entries(F.array_compact(F.array(*complaints.values())))
    out = out.withColumn("errors", errors)
    valid = F.col("patch").isNotNull() & (F.size("errors") == 0)
    stated = F.lit(False)
    updates = {}
    for rule in rules:
        applies = valid & raw(rule).isNotNull()
        stated = stated | raw(rule).isNotNull()
        kind = dict(table.dtypes)[rule.target]
        updates[rule.target] = F.when(applies, rule.value(raw(rule)).cast(kind)).otherwise(F.col(rule.target))
    updates["updated_at"] = F.when(valid & stated, instant(now)).otherwise(F.col("updated_at"))
    return out.withColumns(updates).select(*table.columns, "errors")


def fill_defaults(shows: DataFrame, author_name: str | None, author_email: str | None, now) -> DataFrame:
    """Fill blank author names and emails from the defaults; ``changed`` marks touched rows."""
    changed = F.lit(False)
    updates = {}
    for column, default in (("author_name", author_name), ("author_email", author_email)):
        if default:
            blank = is_blank(F.col(column))
            updates[column] = F.when(blank, F.lit(default)).otherwise(F.col(column))
            changed = changed | blank
    updates["updated_at"] = F.when(changed, instant(now)).otherwise(F.col("updated_at"))
    updates["changed"] = changed
    return shows.withColumns(updates)
