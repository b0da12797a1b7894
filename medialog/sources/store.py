"""Tables on shared storage: an append-only log by day, and snapshots by number.

Parquet has no in-place update, so a changed table is written whole as the next number, a folder of
its own: a writer that starts from a number after which another has been written fails. A folder counts once it is
finished; one that is not is left from a crash, and the next writer replaces it.
Which number is to be read is the caller's to keep; :meth:`Store.current` finds the highest.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialog import schemas
from medialog.sources.files import file_system, is_file, subfolders

TABLES = {
    "shows": schemas.SHOWS,
    "episodes": schemas.EPISODES,
    "scan_log": schemas.SCAN_LOG,
    "login_attempts": schemas.LOGIN_ATTEMPTS,
    "removed_folders": schemas.REMOVED_FOLDERS,
    "settings": schemas.SETTINGS,
}
DAY, BATCH = "requested_date", "batch"
_MARK = "written_by"


# Parquet's own block size; smaller ones let a filter on one episode pass over more.
ROW_GROUP_BYTES = 32 << 20


def append_log(rows: DataFrame, path: str, batch: str, row_group_bytes: int = ROW_GROUP_BYTES) -> None:
    """Add rows to a log: a folder per day, in it one per batch.

    Writing a batch again replaces it, and adds to no other. Rows are dealt by ranges of day, show, episode and
    time, so that a batch has about as many files as it has days and tasks, and an episode's rows lie together. Bloom
    filters of shows and episodes tell a reader which row groups have none of one.
    """
    order = [DAY, "show_id", "episode_id", "requested_at"]
    dated = rows.withColumn(DAY, F.to_date("requested_at")).withColumn(BATCH, F.lit(batch))
    ranged = dated.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = ranged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.block.size", row_group_bytes)
    for column in ("show_id", "episode_id"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", "50000")
    writer.partitionBy(DAY, BATCH).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log with its day and batch columns, for pruning; empty where nothing was written yet."""
    schema = f"{schemas.MEDIA_ACCESS}, {DAY} DATE, {BATCH} STRING"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Store:
    """The tables under one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def current(self, name: str) -> int:
        """The highest number of a snapshot table that is finished; 0 before the first."""
        folders = [f for f in subfolders(f"{self.root}/{name}") if re.fullmatch(r"version=\d+", f)]
        for version in sorted((int(f.split("=")[1]) for f in folders), reverse=True):
            if self._finished(name, version):
                return version
        return 0

    def _finished(self, name: str, version: int) -> bool:
        return is_file(f"{self.root}/{name}/version={version}/_SUCCESS")

    def read(self, name: str, version: int | None = None) -> DataFrame:
        version = self.current(name) if version is None else version
        if not version:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/version={version}")

    def write_snapshot(self, name: str, df: DataFrame, expected: int | None = None, label: str | None = None) -> int:
        """Write the number after ``expected``, by default after the highest; fails if it is there.

        With a ``label`` that names what is written, a number that is there under this label is left as it is: what was
        already written is passed over when a job is run again.
        """
        version = (self.current(name) if expected is None else expected) + 1
        path = f"{self.root}/{name}/version={version}"
        finished = self._finished(name, version)
        if finished and label is not None and self._label(path) == label:
            return version
        # The label is part of the schema, so it is there exactly if the rows are.
        mark = F.lit(True).alias(_MARK, metadata={"label": label or ""})
        df.select("*", mark).write.mode("errorifexists" if finished else "overwrite").parquet(path)
        return version

    def _label(self, path: str) -> str | None:
        fields = {f.name: f for f in self.spark.read.parquet(path).schema.fields}
        return fields[_MARK].metadata.get("label") if _MARK in fields else None

    def write_diagnostics(self, rows: DataFrame, scan: str) -> None:
        """All diagnostics of a scan; writing those of a scan again replaces them."""
        rows.write.mode("overwrite").parquet(f"{self.root}/scan_diagnostics/scan={scan}")

    def diagnostics(self) -> DataFrame:
        """Diagnostics of all scans, with the name of the ``scan``."""
        schema = f"{schemas.SCAN_DIAGNOSTICS}, scan STRING"
        if not subfolders(f"{self.root}/scan_diagnostics"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/scan_diagnostics")

    def append_access(self, rows: DataFrame, batch: str | None = None) -> None:
        """Append log rows; a batch of the same name is replaced."""
        append_log(rows, f"{self.root}/media_access", batch or uuid.uuid4().hex)

    def access_log(self) -> DataFrame:
        """The log, with its day column for partition pruning."""
        return read_log(self.spark, f"{self.root}/media_access").drop(BATCH)

    def drop_days_before(self, now: datetime, days: int) -> list[str]:
        """Delete whole day folders of the log that are past their retention.

        The day the cutoff falls on stays; ``trim_access`` filters it.
        """
        from pyarrow.fs import FileSelector

        first_kept = (now - timedelta(days=days)).date().isoformat()
        system, root = file_system(f"{self.root}/media_access")
        dropped = []
        for entry in system.get_file_info(FileSelector(root)):
            day = entry.base_name.removeprefix(f"{DAY}=")
            if re.fullmatch(r"\d{4}-\d\d-\d\d", day) and day < first_kept:
                system.delete_dir(entry.path)
                dropped.append(day)
        # Spark may hold a listing of the folder.
        self.spark.catalog.refreshByPath(f"{self.root}/media_access")
        return sorted(dropped)
