"""A stored log answered from file footers, and changed file by file."""

from __future__ import annotations

import json
import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medialog.sources.files import file_system, remove_folder, subfolders
from medialog.sources.store import BATCH, DAY, read_log

_STAGED = "_staged-"


# Footers


def day_counts(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """``requested_date``, ``batch``, ``n``: rows by folder, for days of ``[first, last)``.

    The numbers are taken from the footers of the files; no column is read.
    """
    spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    before = spark.conf.get("spark.sql.sources.useV1SourceList")
    # Only the second version of the reader can do so; which one is chosen here.
    spark.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in before.split(",") if x != "parquet"))
    try:
        rows = read_log(spark, path)
    finally:
        spark.conf.set("spark.sql.sources.useV1SourceList", before)
    if first is not None:
        rows = rows.where(F.col(DAY) >= F.lit(first))
    if last is not None:
        rows = rows.where(F.col(DAY) < F.lit(last))
    return rows.groupBy(DAY, BATCH).agg(F.count("*").alias("n"))


def count_days(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """How many rows a stored log has in days of ``[first, last)``."""
    return day_counts(spark, path, first, last).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def stored_extent(spark: SparkSession, path: str) -> DataFrame:
    """First and last time in a stored log: the first and last day by the footers, then those two days' times."""
    edges = day_counts(spark, path).where(F.col("n") > 0).agg(F.min(DAY).alias("first"), F.max(DAY).alias("last")).first()
    rows = read_log(spark, path).where(F.col(DAY).isin(edges["first"], edges["last"]))
    return rows.agg(F.min("requested_at").alias("first_at"), F.max("requested_at").alias("last_at"))


# Deletion


def delete_rows(spark: SparkSession, path: str, doomed: Column) -> list[str]:
    """Delete the rows of a stored log for which ``doomed`` is true; names of the files that were rewritten.

    Files without such rows stay as they are. What is left of the others is written to a hidden folder first, with a plan of what it
    replaces; then the old files go and the new ones take their place. After a crash :func:`finish` carries the
    plan out, and so does the next deletion; without a plan nothing has changed yet. One writer at a time.
    """
    finish(spark, path)
    log = read_log(spark, path).withColumn("file", F.col("_metadata.file_path"))
    touched = log.where(doomed).select("file").distinct()
    names = [r["file"] for r in touched.collect()]  # files, not rows
    if not names:
        return []
    staged = f"{path}/{_STAGED}{uuid.uuid4().hex}"
    order = [DAY, "show_id", "requested_at"]
    kept = log.join(touched, "file", "left_semi").where(~F.coalesce(doomed, F.lit(False))).drop("file")
    kept.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy(DAY, BATCH).parquet(f"{staged}/rows")
    system, name = file_system(f"{staged}/plan.json")
    with system.open_output_stream(name) as out:
        out.write(json.dumps(names).encode())
    finish(spark, path)
    return names


def finish(spark: SparkSession, path: str) -> None:
    """Carry out deletions that a crash broke off; staged rows without a plan are dropped."""
    from pyarrow.fs import FileSelector, FileType

    for folder in subfolders(path):
        if not folder.startswith(_STAGED):
            continue
        system, staged = file_system(f"{path}/{folder}")
        if system.get_file_info(f"{staged}/plan.json").type == FileType.File:
            with system.open_input_stream(f"{staged}/plan.json") as f:
                old = json.loads(f.read())
            for address in old:
                _, name = file_system(_unescaped(address))
                if system.get_file_info(name).type == FileType.File:
                    system.delete_file(name)
            _, root = file_system(path)
            for info in system.get_file_info(FileSelector(f"{staged}/rows", recursive=True)):
                if info.type == FileType.File and info.base_name.startswith("part-"):
                    target = f"{root}/{info.path[len(staged) + len('/rows/'):]}"
                    system.create_dir(target.rpartition("/")[0], recursive=True)
                    system.move(info.path, target)
        remove_folder(f"{path}/{folder}")
    spark.catalog.refreshByPath(path)


def _unescaped(address: str) -> str:
    """Spark names files with escapes."""
    from urllib.parse import unquote

    return unquote(address)


def drop_show(spark: SparkSession, path: str, show_id: str) -> list[str]:
    """Delete a show's rows."""
    return delete_rows(spark, path, F.col("show_id") == show_id)
