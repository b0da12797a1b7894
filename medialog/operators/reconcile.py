"""Bringing the catalogue into line with a file listing, for all shows at once.

The reference point is a scan that walks one show file by file. Here the same rules are set
operations keyed by (show, file name) and (show, identity):

1. a file whose name, size, time and type equal the live row of that name is taken as seen;
2. every other readable audio file is matched by content identity;
3. of files with one identity, one claims it: the file the catalogue already knows under that
   name, else the lowest ordinal and name; the others are duplicates;
4. claims meet the catalogue in a full outer join, which tells new, changed and vanished rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialog.functions.moments import instant
from medialog.functions.text import audio_type, file_class, title_from_filename
from medialog.operators.catalogue import live_row_per_filename
from medialog.operators.joins import lookup_join, spread
from medialog.schemas import EPISODES, LISTING

KEY = ["show_id", "identity_key"]
NAME = ["show_id", "filename"]
COUNTERS = ("files_found", "added", "updated", "missing", "removed")
_TAGS = ("tag_title", "tag_description", "tag_season", "tag_episode_number", "duration_seconds", "bitrate_kbps")
_FILE = ("filename", "size_bytes", "mtime", "mime_type", "fast", "tag_error", *_TAGS)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema; absent ones are NULL."""
    fields = T.StructType.fromDDL(ddl).fields
    present = set(df.columns)
    return df.selectExpr(
        *[
            f"CAST({f'`{f.name}`' if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
            for f in fields
        ]
    )


class Reconciled:
    """One pass: ``rows`` holds every catalogue row with its verdict, the rest follows from it."""

    def __init__(self, listing: DataFrame, audio: DataFrame, matched: DataFrame, claims: DataFrame, rows: DataFrame):
        self._listing, self._audio, self._matched, self._claims = listing, audio, matched, claims
        self.rows = rows

    @property
    def episodes(self) -> DataFrame:
        """The new snapshot of the catalogue."""
        return self.rows.select("after.*")

    @property
    def changes(self) -> DataFrame:
        return self.rows.where(F.col("action") != "kept").select(
            F.col("after.id").alias("episode_id"),
            "show_id",
            "identity_key",
            "action",
            "changed",
            F.col("before.status").alias("status_before"),
            F.col("after.status").alias("status_after"),
            F.col("after.filename").alias("filename"),
        )

    @property
    def counters(self) -> DataFrame:
        return _counters(self._audio, self.rows)

    @property
    def diagnostics(self) -> DataFrame:
        # A file that was not hashed is as good as unreadable.
        unhashed = self._matched.where("identity_key IS NULL").select(*NAME, F.lit("not hashed").alias("error_code"))
        failed = self._audio.where("error_code IS NOT NULL").select(*NAME, "error_code").unionByName(unhashed)
        files = self._matched.where("identity_key IS NOT NULL")
        return _diagnostics(self._listing, failed, files, self._claims, self.rows)

    def with_rows(self, rows: DataFrame) -> Reconciled:
        """The same pass over rows that were written out and read back."""
        return Reconciled(self._listing, self._audio, self._matched, self._claims, rows)


def stable_id(salt: str, *parts: Column) -> Column:
    """UUID-shaped id from content, so that a recomputed task yields the same one."""
    digest = F.sha2(F.concat_ws("|", F.lit(salt), *parts), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, at, n) for at, n in cuts])


def fast_match(audio: DataFrame, episodes: DataFrame) -> DataFrame:
    """Flag files that equal the live catalogue row of their name; they need no hashing."""
    live = live_row_per_filename(
        spread(episodes, "id").select("id", *NAME, "identity_key", "status", "updated_at", "file_size_bytes", "file_mtime", "mime_type")
    ).select(
        *NAME,
        F.struct("identity_key", "file_size_bytes", "file_mtime", "mime_type").alias("live"),
    )
    same = (
        F.col("live.file_size_bytes").eqNullSafe(F.col("size_bytes"))
        & F.col("live.file_mtime").eqNullSafe(F.col("mtime"))
        & F.col("live.mime_type").eqNullSafe(F.col("mime_type"))
    )
    # The catalogue is as large as the listing. Spark would go by the size of its files and send it to every task.
    joined = audio.join(live.hint("merge"), NAME, "left")
    return joined.withColumns(
        {
            "fast": F.col("live").isNotNull() & same,
            "identity_key": F.when(F.col("live").isNotNull() & same, F.col("live.identity_key")).otherwise(
                F.col("identity_key")
            ),
        }
    ).drop("live")


def claim_identities(files: DataFrame, episodes: DataFrame) -> DataFrame:
    """One claiming file per (show, identity), as a struct, and how many files share it.

    A grouped minimum: any number of copies is combined before the shuffle.
    """
    known = episodes.select(*KEY, "filename", F.lit(True).alias("incumbent"))
    order = F.struct(
        ~F.col("fast"),
        ~F.coalesce("incumbent", F.lit(False)),
        F.coalesce("ordinal", F.lit(0)),
        F.col("filename"),
    )
    return (
        files.join(known.hint("merge"), [*KEY, "filename"], "left")
        .groupBy(*KEY)
        .agg(F.min_by(F.struct(*_FILE), order).alias("file"), F.count("*").alias("copies"))
    )


# Parts that the files of one identity are spread over.
SALTS = 16


def duplicate_files(files: DataFrame, claims: DataFrame) -> DataFrame:
    """Files whose audio another file already claimed, with that file's name.

    One identity may have a third of all files. The claims are a grouping by the key of this join, and Spark does not split a
    partition that it has just grouped, so the files are spread.
    """
    shared = claims.where(F.col("copies") > 1).select(*KEY, F.col("file.filename").alias("claimed_by"))
    return lookup_join(files, shared, KEY, ["filename"], "inner", SALTS).where(F.col("filename") != F.col("claimed_by"))


def reconcile(
    listing: DataFrame, episodes: DataFrame, now, id_salt: str = "scan", rehash: bool = False
) -> Reconciled:
    """One pass over the whole library. ``id_salt`` names the scan and enters new ids."""
    listing = conform(listing, LISTING)
    episodes = conform(episodes, EPISODES)
    now = instant(now)
    audio = listing.withColumn("mime_type", audio_type(F.col("filename"))).where("mime_type IS NOT NULL")
    readable = audio.where("error_code IS NULL").drop("error_code")
    matched = readable.withColumn("fast", F.lit(False)) if rehash else fast_match(readable, episodes)
    claims = claim_identities(matched.where("identity_key IS NOT NULL"), episodes)
    return Reconciled(listing, audio, matched, claims, _verdicts(claims, episodes, now, id_salt))


TRACKED = (
    "filename", "file_mtime", "file_size_bytes", "mime_type", "duration_seconds", "bitrate_kbps",
    "tag_title", "title", "status", "missing_since", "removed_at",
)


def _verdicts(claims: DataFrame, episodes: DataFrame, now: Column, id_salt: str) -> DataFrame:
    """Full outer join of claims and catalogue, then one verdict and one new row per pair.

    Flags, new values and verdicts are separate columns, so that each is computed once.
    """
    stored = episodes.select(*KEY, F.struct(*episodes.columns).alias("before"))
    both = claims.select(*KEY, "file").join(stored, KEY, "full")
    before, file = F.col("before"), F.col("file")
    status = F.coalesce(before["status"], F.lit(""))
    fast = F.coalesce(file["fast"], F.lit(False))
    both = both.withColumns(
        {
            "is_new": before.isNull(),
            "seen": file.isNotNull(),
            "revive": file.isNotNull() & status.isin("missing", "expired"),
            "gone": file.isNull() & (status == "active"),
            # A matched row, not removed, takes over what differs in a file that is no fast match.
            "follows": file.isNotNull() & before.isNotNull() & (status != "removed") & ~fast,
            "renamed_removed": file.isNotNull()
            & (status == "removed")
            & ~fast
            & (before["filename"] != file["filename"]),
        }
    )
    c = F.col
    both = both.withColumn(
        "reads_tags",
        c("follows") & (before["duration_seconds"].isNull() | (before["file_size_bytes"] != file["size_bytes"])),
    )
    title = F.nullif(file["tag_title"], F.lit(""))

    def follow(condition: Column, new: Column, column: str) -> Column:
        return F.when(condition & new.isNotNull(), new).otherwise(before[column])

    moved = c("follows") | c("renamed_removed")
    values = {
        "filename": follow(moved, file["filename"], "filename"),
        "file_mtime": follow(moved, file["mtime"], "file_mtime"),
        "file_size_bytes": follow(c("follows"), file["size_bytes"], "file_size_bytes"),
        "mime_type": follow(c("follows"), file["mime_type"], "mime_type"),
        "duration_seconds": follow(c("reads_tags"), file["duration_seconds"], "duration_seconds"),
        "bitrate_kbps": follow(c("reads_tags"), file["bitrate_kbps"], "bitrate_kbps"),
        "tag_title": follow(c("reads_tags"), title, "tag_title"),
        "title": follow(c("reads_tags") & (before["title_is_custom"] == 0), title, "title"),
        "status": F.when(c("revive"), "active").when(c("gone"), "missing").otherwise(before["status"]),
        "missing_since": F.when(c("gone"), now).when(~c("revive"), before["missing_since"]),
        "removed_at": F.when(~c("revive"), before["removed_at"]),
    }
    both = both.withColumn("now", F.struct(*[values[name].alias(name) for name in TRACKED]))
    moved_names = ", ".join(f"CASE WHEN NOT (now.{n} <=> before.{n}) THEN '{n}' END" for n in TRACKED)
    both = both.withColumn("changed", F.expr(f"IF(is_new, CAST(array() AS ARRAY<STRING>), array_compact(array({moved_names})))"))
    touched = F.size("changed") > 0
    action = (
        F.when(c("is_new"), "added")
        .when(c("gone"), "missing")
        .when(~c("seen") & (status == "missing"), "still_missing")
        .when(c("renamed_removed"), "removed_renamed")
        .when(touched, "updated")
        .otherwise("kept")
    )
    both = both.withColumns(
        {
            "action": action,
            "scan_time": now,
            "new_id": stable_id(id_salt, F.col("show_id"), F.col("identity_key")),
            "new_title": F.coalesce(file["tag_title"], title_from_filename(file["filename"])),
        }
    )
    old = {n: f"now.{n}" if n in TRACKED else f"before.{n}" for n in episodes.columns}
    old["updated_at"] = "IF(size(changed) > 0, scan_time, before.updated_at)"
    after = f"IF(is_new, {_row(NEW_ROW, episodes)}, {_row(old, episodes)})"
    return both.select(
        *KEY,
        "before",
        "file",
        F.expr(after).alias("after"),
        "action",
        "changed",
        (c("revive") & (status == "expired")).alias("returned"),
        (c("seen") & (c("is_new") | c("reads_tags")) & F.coalesce(file["tag_error"], F.lit(False))).alias("tags_unread"),
    )


# Columns of a row for a new file; all others are NULL.
NEW_ROW = {
    "id": "new_id",
    "show_id": "show_id",
    "identity_key": "identity_key",
    "filename": "file.filename",
    "title": "new_title",
    "title_is_custom": "0",
    "tag_title": "file.tag_title",
    "description": "coalesce(file.tag_description, '')",
    "season": "file.tag_season",
    "episode_number": "file.tag_episode_number",
    "episode_type": "'full'",
    "pub_date": "file.mtime",
    "pub_date_is_custom": "0",
    "duration_seconds": "file.duration_seconds",
    "bitrate_kbps": "file.bitrate_kbps",
    "file_size_bytes": "file.size_bytes",
    "file_mtime": "file.mtime",
    "mime_type": "file.mime_type",
    "status": "'active'",
    "created_at": "scan_time",
    "updated_at": "scan_time",
}


def _row(values: dict[str, str], episodes: DataFrame) -> str:
    """SQL of a struct with the columns and types of the catalogue."""
    return "named_struct({})".format(
        ", ".join(f"'{n}', CAST({values.get(n, 'NULL')} AS {kind})" for n, kind in episodes.dtypes)
    )


def _counters(audio: DataFrame, rows: DataFrame) -> DataFrame:
    """Per show: files found, added, updated, missing (new and still), removed (always 0)."""
    found = audio.groupBy("show_id").agg(F.count("*").alias("files_found"))
    verdicts = rows.groupBy("show_id").agg(
        F.count_if(F.col("action") == "added").alias("added"),
        F.count_if(F.col("action") == "updated").alias("updated"),
        F.count_if(F.col("action").isin("missing", "still_missing")).alias("missing"),
    )
    both = found.join(verdicts, "show_id", "full").na.fill(0, ["files_found", "added", "updated", "missing"])
    return both.withColumn("removed", F.lit(0).cast("bigint"))


def _line(level: str, code: str, file: Column, *message: Column | str) -> list[Column]:
    parts = [F.lit(p) if isinstance(p, str) else p for p in message]
    return [
        F.col("show_id"),
        F.lit(level).alias("level"),
        F.lit(code).alias("code"),
        file.alias("file"),
        F.concat(*parts).alias("message"),
    ]


def _diagnostics(listing, failed, files, claims, rows) -> DataFrame:
    """Warnings and errors of the pass, one row each."""
    name = F.col("filename")
    unsupported = listing.where(file_class(name) == "unsupported").select(
        *_line("warning", "unsupported", name, "`", name, "` was ignored: this file type is not served.")
    )
    unreadable = failed.select(
        *_line("error", "unreadable", name, "`", name, "` could not be read (", F.col("error_code"), ").")
    )
    copies = duplicate_files(files.select(*KEY, "filename"), claims).select(
        *_line("warning", "duplicate", name, "`", name, "` has the same audio as `", F.col("claimed_by"),
               "` and is not published on its own.")
    )
    kept = F.col("after.filename")
    lost = rows.where(F.col("action") == "missing").select(
        *_line("warning", "gone", kept, "`", kept, "` is no longer on disk; it leaves the feed after the grace period.")
    )
    back = rows.where("returned").select(
        *_line("warning", "returned", kept, "`", kept, "` is back after the grace period and keeps its identity.")
    )
    unread = rows.where("tags_unread").select(
        *_line("warning", "tags", kept, "`", kept, "`: tags or length could not be read; the duration is left out.")
    )
    out = unsupported
    for part in (unreadable, copies, lost, back, unread):
        out = out.unionByName(part)
    return out
