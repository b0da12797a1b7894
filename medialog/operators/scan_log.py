"""The operational log of scans: filtering, paging, diagnostics, retention, totals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialog.functions.moments import instant
from medialog.operators.access_log import within
from medialog.operators.joins import lookup_join
from medialog.schemas import SCAN_OUTCOMES, SCAN_TRIGGERS

MAX_DIAGNOSTICS = 50
ENTRY = "file STRING, message STRING, code STRING"
_COUNTERS = ("added", "updated", "missing", "removed")


def outcome_test(outcome: str) -> Column:
    has_errors, has_warnings = F.col("errors_json").isNotNull(), F.col("warnings_json").isNotNull()
    finished = F.col("finished_at").isNotNull()
    moved = sum((F.coalesce(F.col(c), F.lit(0)) for c in _COUNTERS[1:]), F.coalesce(F.col(_COUNTERS[0]), F.lit(0)))
    return {
        "problems": has_errors | has_warnings,
        "errors": has_errors,
        "clean": finished & ~has_errors & ~has_warnings,
        "changes": moved > 0,
        "running": ~finished,
    }[outcome]


@dataclass(frozen=True)
class ScanFilter:
    show_id: str | None = None
    include_global: bool = True
    triggers: Sequence[str] | None = None
    outcome: str | None = None
    frm: datetime | None = None
    to: datetime | None = None

    def apply(self, scans: DataFrame) -> DataFrame:
        if self.show_id:
            mine = F.col("show_id") == self.show_id
            scans = scans.where(mine | F.col("show_id").isNull() if self.include_global else mine)
        triggers = [t for t in SCAN_TRIGGERS if t in (self.triggers or ())]
        if 0 < len(triggers) < len(SCAN_TRIGGERS):
            scans = scans.where(F.col("trigger").isin(*triggers))
        if self.outcome in SCAN_OUTCOMES:
            scans = scans.where(outcome_test(self.outcome))
        return within(scans, self.frm, self.to, "started_at")


def enrich_scans(scans: DataFrame, shows: DataFrame) -> DataFrame:
    """Show names beside scans; global scans have none."""
    names = shows.select(
        F.col("id").alias("show_id"), F.col("title").alias("show_title"), F.col("slug").alias("show_slug")
    )
    return lookup_join(scans, names, ["show_id"], ["id"])


def page_scans(scans: DataFrame, limit: int = 25, offset: int = 0) -> DataFrame:
    out = scans.orderBy(F.desc("started_at"), F.desc("id"))
    if offset > 0:
        out = out.offset(int(offset))
    return out.limit(max(1, int(limit)))


def count_scans(scans: DataFrame, filters: ScanFilter = ScanFilter()) -> DataFrame:
    return filters.apply(scans).agg(F.count("*").alias("n"))


def list_scans(scans: DataFrame, shows: DataFrame, filters=ScanFilter(), limit: int = 25, offset: int = 0) -> DataFrame:
    """Filter, cut the page, then look the names up."""
    return enrich_scans(page_scans(filters.apply(scans), limit, offset), shows)


def latest_scan(scans: DataFrame) -> DataFrame:
    """Latest finished scan of every show, and of the library (show_id NULL)."""
    columns = [c for c in scans.columns if c != "show_id"]
    last = F.max_by(F.struct(*columns), F.struct("started_at", "id"))
    return (
        scans.where(F.col("finished_at").isNotNull())
        .groupBy("show_id")
        .agg(last.alias("scan"))
        .select("show_id", "scan.*")
    )


def trim_scans(scans: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` rows of the scan log. A pass writes a row per show."""
    return scans.orderBy(F.desc("started_at"), F.desc("id")).limit(keep)


def parse_entries(text: Column) -> Column:
    """Diagnostics of a stored JSON list; anything else is an empty list."""
    # An object would parse into one all-NULL entry, so only lists are parsed.
    parsed = F.when(F.ltrim(text).startswith("["), F.from_json(text, f"ARRAY<STRUCT<{ENTRY.replace(' STRING', ': STRING')}>>"))
    return F.coalesce(parsed, F.array().cast(f"ARRAY<STRUCT<{ENTRY.replace(' STRING', ': STRING')}>>"))


def explode_diagnostics(scans: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per stored error or warning, with further scan columns if wanted."""
    tagged = F.concat(
        F.transform(parse_entries(F.col("errors_json")), lambda e: F.struct(F.lit("error").alias("level"), e.alias("entry"))),
        F.transform(parse_entries(F.col("warnings_json")), lambda e: F.struct(F.lit("warning").alias("level"), e.alias("entry"))),
    )
    return scans.select("id", "show_id", *keep, F.explode(tagged).alias("d")).select(
        F.col("id").alias("scan_id"), "show_id", *keep, "d.level", "d.entry.file", "d.entry.message", "d.entry.code"
    )


def more_line(hidden: Column) -> Column:
    return F.concat(F.lit("…and "), hidden.cast("string"), F.lit(" more like these."))


def cap_entries(entries: Column, n: int = MAX_DIAGNOSTICS) -> Column:
    """The first n entries, then one that counts the rest."""
    rest = F.struct(
        F.lit(None).cast("string").alias("file"),
        more_line(F.size(entries) - n).alias("message"),
        F.lit(None).cast("string").alias("code"),
    )
    return F.when(F.size(entries) > n, F.concat(F.slice(entries, 1, n), F.array(rest))).otherwise(entries)


def capped_diagnostics(diagnostics: DataFrame, by: list[str], order: list[str], n: int = MAX_DIAGNOSTICS) -> DataFrame:
    """Diagnostics rows to one capped list per group.

    Only the first n of a group are ever gathered: ranks are limited per task before the
    shuffle, and the rest is counted.
    """
    first = Window.partitionBy(*by).orderBy(*order)
    entry = F.struct("file", "message", "code")
    kept = (
        diagnostics.withColumn("rank", F.row_number().over(first))
        .where(F.col("rank") <= n)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("kept"))
    )
    sizes = diagnostics.groupBy(*by).agg(F.count("*").alias("n"))
    rest = F.struct(
        F.lit(None).cast("string").alias("file"),
        more_line(F.col("n") - n).alias("message"),
        F.lit(None).cast("string").alias("code"),
    )
    entries = F.transform("kept", lambda k: k["entry"])
    # NULL is a group like others.
    sized = sizes.select(*[F.col(c).alias(f"__{c}") for c in by], "n")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return kept.join(sized, same).select(
        *by,
        "n",
        F.when(F.col("n") > n, F.concat(entries, F.array(rest))).otherwise(entries).alias("entries"),
    )


def all_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """Every diagnostic of a pass as a table of its own; the log's lists are cut."""
    return diagnostics.select("show_id", "level", F.col("file"), F.col("message"), F.col("code"))


def to_scan_rows(counters: DataFrame, diagnostics: DataFrame, started_at, finished_at, trigger: str, n: int = MAX_DIAGNOSTICS) -> DataFrame:
    """Log rows of one pass: a row per show, the first ``n`` diagnostics of each level as JSON lists, the rest counted.

    :func:`all_diagnostics` has the rest.
    """
    capped = capped_diagnostics(
        diagnostics.withColumns({"code": F.col("code"), "file": F.col("file")}), ["show_id", "level"], ["code", "file"], n
    )
    lists = capped.groupBy("show_id").agg(
        *[
            F.max(F.when(F.col("level") == level, F.to_json("entries"))).alias(f"{level}s_json")
            for level in ("error", "warning")
        ]
    )
    found = lists.withColumnRenamed("show_id", "__show")
    # The row of the whole library has no show.
    return counters.join(found, F.col("show_id").eqNullSafe(F.col("__show")), "full").select(
        F.coalesce("show_id", "__show").alias("show_id"),
        instant(started_at).alias("started_at"),
        instant(finished_at).alias("finished_at"),
        F.lit(trigger).alias("trigger"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in ("files_found", *_COUNTERS)],
        "errors_json",
        "warnings_json",
    )


def with_total(counters: DataFrame) -> DataFrame:
    """Counters per show, and a row without a show that sums them up."""
    names = [c for c in ("files_found", *_COUNTERS) if c in counters.columns]
    total = counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).withColumn("show_id", F.lit(None).cast("string"))
    return counters.select("show_id", *names).unionByName(total)


def scan_totals(results: DataFrame, by: list[str]) -> DataFrame:
    """Library totals of per-show results, with how many problems they report."""
    return results.groupBy(*by).agg(
        F.count("*").alias("shows"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("files_found", *_COUNTERS)],
        F.sum(F.size(parse_entries(F.col("errors_json")))).alias("errors"),
        F.sum(F.size(parse_entries(F.col("warnings_json")))).alias("warnings"),
    )


def library_diagnostics(results: DataFrame, by: list[str]) -> DataFrame:
    """The concatenated, capped diagnostics of a whole sweep."""
    rows = explode_diagnostics(results, by)
    return capped_diagnostics(rows, [*by, "level"], ["scan_id", "file", "message"])
