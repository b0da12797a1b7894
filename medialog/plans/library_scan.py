"""One sweep of the library: discovery, reconciliation, artwork, log rows, new snapshots."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.functions.text import audio_type
from medialog.operators.artwork import apply_art, apply_covers, art_changes, choose_art, sidecar_art
from medialog.operators.discover import apply_discovery, discover, new_shows
from medialog.operators.joins import lookup_join
from medialog.operators.lifecycle import sweep_missing
from medialog.operators.reconcile import conform, fast_match, reconcile
from medialog.operators.scan_log import all_diagnostics, to_scan_rows, trim_scans, with_total
from medialog.schemas import LISTING, SCAN_LOG, SHOWS
from medialog.session import workspace
from medialog.sources.listing import files_of, with_identity
from medialog.sources.store import Store


def listed_files(library: DataFrame, shows: DataFrame, episodes: DataFrame, rehash: bool = False) -> DataFrame:
    """The files of a library (:func:`read_library`), with the identity of every audio file.

    Files that equal their catalogue row by name, size, time and type take its identity; only
    the rest are opened. Files of folders that are no show yet have a slug and no show id.
    """
    slugs = shows.select("slug", F.col("id").alias("show_id"))
    found = lookup_join(files_of(library), slugs, ["slug"], ["filename"])
    typed = found.withColumn("mime_type", audio_type(F.col("filename"))).withColumn(
        "identity_key", F.lit(None).cast("string")
    )
    schema = f"{LISTING}, slug STRING"
    other = typed.where("mime_type IS NULL")
    audio = typed.where("mime_type IS NOT NULL")
    if rehash:
        parts = [with_identity(audio.drop("identity_key"))]
    else:
        known = audio.where("show_id IS NOT NULL")
        matched = fast_match(known, episodes)
        unseen = matched.where(~F.col("fast")).drop("identity_key", "fast").unionByName(
            audio.where("show_id IS NULL").drop("identity_key"), allowMissingColumns=True
        )
        parts = [matched.where("fast"), with_identity(unseen)]
    out = conform(other, schema)
    for part in parts:
        out = out.unionByName(conform(part, schema))
    return out


@dataclass(frozen=True)
class Sweep:
    """What a sweep produced, before it is stored."""

    shows: DataFrame
    episodes: DataFrame
    changes: DataFrame
    counters: DataFrame
    diagnostics: DataFrame
    folder_verdicts: DataFrame
    #: Folders that could not be read.
    unread: DataFrame


@dataclass(frozen=True)
class NewShows:
    """What a sweep needs to make shows of new folders."""

    #: Parsed config files by slug.
    configs: DataFrame
    defaults: dict[str, str]
    #: Feed tokens are derived with it; it must not be stored beside the data.
    token_secret: str


def folder_diagnostics(verdicts: DataFrame, unread: DataFrame) -> DataFrame:
    """Warnings and errors of a sweep that belong to no show."""
    told = {
        "vanished": "The folder `{}` is gone; its show stays, its feed rests.",
        "ignored": "The folder `{}` was removed by hand before and is left out.",
        "skipped": "The folder `{}` is left out: its name is not usable in addresses.",
    }

    def lines(rows: DataFrame, level: str, code: str, text: str) -> DataFrame:
        before, after = text.split("{}")
        message = F.concat(F.lit(before), "slug", F.lit(after))
        return rows.select(
            F.lit(None).cast("string").alias("show_id"), F.lit(level).alias("level"), F.lit(code).alias("code"),
            F.col("slug").alias("file"), message.alias("message"),
        )

    out = lines(unread, "error", "unreadable", "The folder `{}` could not be read; nothing in it was changed.")
    for verdict, text in told.items():
        out = out.unionByName(lines(verdicts.where(F.col("verdict") == verdict), "warning", verdict, text))
    return out


def sweep(
    listing: DataFrame,
    folders: DataFrame,
    shows: DataFrame,
    episodes: DataFrame,
    tombstones: DataFrame,
    images: DataFrame | None,
    now: datetime,
    scan_key: str,
    grace_seconds: int = 24 * 3600,
    rehash: bool = False,
    create: NewShows | None = None,
) -> Sweep:
    """Bring shows and episodes into line with what is on disk.

    With ``create``, new folders become shows and their files episodes. Episodes of shows whose
    folder is gone, or could not be read (``error_code`` of ``folders``), are left alone: nothing was
    seen of them. Covers follow the cover files found.
    """
    spark = listing.sparkSession
    verdicts = discover(folders.select("slug"), shows, tombstones)
    shows_now = apply_discovery(shows, verdicts, now)
    if create is not None:
        fresh_shows = new_shows(verdicts, create.configs, create.defaults, now, scan_key, create.token_secret)
        shows_now = conform(shows_now, SHOWS).unionByName(fresh_shows)
        if "slug" in listing.columns:
            ids = fresh_shows.select("slug", F.col("id").alias("new_id"))
            listing = lookup_join(listing, ids, ["slug"], ["filename"]).withColumn("show_id", F.coalesce("show_id", "new_id"))
    unread = folders.where("error_code IS NOT NULL").select("slug") if "error_code" in folders.columns else folders.where("false").select("slug")
    active = shows_now.where(F.col("status") == "active").join(unread, "slug", "left_anti").select(F.col("id").alias("show_id"))
    files = lookup_join(conform(listing, LISTING), active, ["show_id"], ["filename"], "left_semi")
    shows_now = apply_covers(shows_now, files, active, now)
    scanned = lookup_join(episodes, active, ["show_id"], ["id"], "left_semi")
    untouched = lookup_join(episodes, active, ["show_id"], ["id"], "left_anti")

    done = reconcile(files, scanned, now, scan_key, rehash)
    # The verdicts feed four results: write them once, to storage that outlives an executor.
    path = workspace(spark, "verdicts")
    done.rows.write.parquet(path)
    done = done.with_rows(spark.read.parquet(path))

    fresh = done.episodes
    if images is not None:
        wanted = choose_art(fresh, sidecar_art(files), images)
        fresh = apply_art(fresh, art_changes(fresh, wanted), now)
    fresh = sweep_missing(fresh.unionByName(untouched, allowMissingColumns=True), now, grace_seconds)
    return Sweep(shows_now, fresh, done.changes, done.counters, done.diagnostics, verdicts, unread)


def store_sweep(
    store: Store, result: Sweep, started_at: datetime, finished_at: datetime, trigger: str, base: dict[str, int], keep_scans: int | None = None
) -> None:
    """Write the snapshots and append the scan log, with all diagnostics in a table of their own.

    ``base`` has the version read of each of ``episodes``, ``shows`` and ``scan_log``; a table that another
    writer moved on since then fails. ``keep_scans`` limits the rows of the scan log, all shows
    together; by default none is dropped. After a crash the sweep of the same start and ``base`` can be stored
    again: what it has written is passed over.
    """
    stamp = int(started_at.replace(tzinfo=timezone.utc).timestamp() * 1000)
    label = f"sweep-{stamp}"
    store.write_snapshot("episodes", result.episodes, base["episodes"], label)
    store.write_snapshot("shows", result.shows, base["shows"], label)
    diagnostics = result.diagnostics.unionByName(folder_diagnostics(result.folder_verdicts, result.unread), allowMissingColumns=True)
    store.write_diagnostics(all_diagnostics(diagnostics), label)
    rows = to_scan_rows(with_total(result.counters), diagnostics, started_at, finished_at, trigger)
    keyed = rows.withColumn("id", F.xxhash64(F.lit(stamp), "show_id"))
    log = store.read("scan_log", base["scan_log"]).unionByName(conform(keyed, SCAN_LOG))
    store.write_snapshot("scan_log", trim_scans(log, keep_scans) if keep_scans else log, base["scan_log"], label)
