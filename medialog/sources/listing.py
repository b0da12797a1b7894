"""Directory listings and content identities of audio files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialog.sources.files import file_system

WINDOW_BYTES = 1024 * 1024
WHOLE_BYTES = 2 * WINDOW_BYTES


_ENTRY = "slug STRING, filename STRING, path STRING, size_bytes BIGINT, mtime TIMESTAMP, error_code STRING"


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow.fs import FileSelector, FileType

    for batch in batches:
        for slug, folder in zip(batch["slug"], batch["path"]):
            rows = []
            try:
                system, name = file_system(folder)
                for entry in system.get_file_info(FileSelector(name)):
                    if entry.type == FileType.File and not entry.base_name.startswith("."):
                        rows.append((slug, entry.base_name, f"{folder}/{entry.base_name}", entry.size, pd.Timestamp(entry.mtime_ns // 1000, unit="us"), None))
                error = None
            except Exception as err:  # any failure of a folder is its error code, and it lists nothing
                rows, error = [], type(err).__name__
            # The folder itself, with or without files.
            rows.append((slug, None, folder, None, None, error))
            out = pd.DataFrame(rows, columns=["slug", "filename", "path", "size_bytes", "mtime", "error_code"])
            yield out.astype({"size_bytes": "Int64"})


def read_library(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """Folders below ``root`` and the files in them: slug, filename, path, size_bytes, mtime, error_code.

    A folder is a row without a filename, whether it holds files or not; one that cannot be read has
    an error code and no files. File contents are never read. Names that start with a dot and
    deeper files are left out. The driver sees the folders' names only; the folders are listed in
    the tasks.
    """
    from pyarrow.fs import FileSelector, FileType

    root = root.rstrip("/")
    system, name = file_system(root)
    slugs = [e.base_name for e in system.get_file_info(FileSelector(name)) if e.type == FileType.Directory and not e.base_name.startswith(".")]
    folders = spark.createDataFrame([(s, f"{root}/{s}") for s in sorted(slugs)], "slug STRING, path STRING")
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism
    return folders.repartition(tasks, "slug").mapInPandas(_entries, _ENTRY)


def files_of(library: DataFrame) -> DataFrame:
    """The files of :func:`read_library`."""
    return library.where("filename IS NOT NULL").select("slug", "filename", "path", "size_bytes", "mtime")


def folders_of(library: DataFrame) -> DataFrame:
    """The folders of :func:`read_library`: slug, error_code."""
    return library.where("filename IS NULL").select("slug", "error_code")


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    """Files one level below the folders of ``root``: slug, filename, path, size_bytes, mtime."""
    return files_of(read_library(spark, root))


def content_identity(content: Column, window: int = WINDOW_BYTES) -> Column:
    """Identity of bytes at hand: head window, tail window and size; short content whole."""
    size = F.octet_length(content)
    ends = F.concat(F.substring(content, 1, window), F.substring(content, -window, window))
    kept = F.when(size <= 2 * window, content).otherwise(ends)
    return F.sha2(F.concat(kept, F.encode(size.cast("string"), "UTF-8")), 256)


def _file_identity(path: str, size: int) -> str:
    system, name = file_system(path)
    digest = hashlib.sha256()
    with system.open_input_file(name) as handle:
        if size <= WHOLE_BYTES:
            digest.update(handle.read(size))
        else:
            digest.update(handle.read_at(WINDOW_BYTES, 0))
            digest.update(handle.read_at(WINDOW_BYTES, size - WINDOW_BYTES))
    digest.update(str(size).encode())
    return digest.hexdigest()


def _identify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keys, errors = [], []
        for path, size in zip(batch["path"], batch["size_bytes"]):
            try:
                keys.append(_file_identity(path, int(size)))
                errors.append(None)
            except Exception as err:  # any failure of a single file is its error code
                keys.append(None)
                errors.append(type(err).__name__)
        yield batch.assign(identity_key=keys, error_code=errors)


def with_identity(files: DataFrame, tasks: int | None = None) -> DataFrame:
    """Read at most two windows of each listed file. A file that fails gets an error code.

    Rows are few bytes but much reading, so they are spread over a fixed number of tasks that
    Spark will not merge; by default four per core.
    """
    tasks = tasks or 4 * files.sparkSession.sparkContext.defaultParallelism
    fields = ", ".join(f"`{name}` {kind}" for name, kind in files.dtypes)
    spread = files.repartition(tasks, "path")
    return spread.mapInPandas(_identify, f"{fields}, identity_key STRING, error_code STRING")

