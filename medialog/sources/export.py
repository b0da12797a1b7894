"""CSV export of the access log and text export of feed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.functions.text import csv_cell
from medialog.operators.access_log import (
    SORTS,
    AccessFilter,
    enrich_log,
    export_columns,
    with_outcome_flags,
)
from medialog.operators.feeds import document_order

BYTE_ORDER_MARK = "﻿"


def csv_lines(rows: DataFrame, sort: str = "time") -> DataFrame:
    """(section, key, id, line): the header, then one line per enriched log row with its sort key."""
    columns = export_columns()
    line = F.concat_ws(",", *[csv_cell(column) for column in columns.values()])
    key = F.expr(SORTS.get(sort, SORTS["time"]))
    body = rows.select(F.lit(1).alias("section"), key.alias("key"), "id", line.alias("line"))
    head = rows.sparkSession.range(1).select(
        F.lit(0).alias("section"),
        F.lit(None).cast(body.schema["key"].dataType).alias("key"),
        F.lit(None).cast("bigint").alias("id"),
        F.lit(BYTE_ORDER_MARK + ",".join(columns)).alias("line"),
    )
    return head.unionByName(body)


def export_access_log(
    log: DataFrame, episodes: DataFrame, shows: DataFrame, path: str, filters: AccessFilter = AccessFilter(),
    sort: str = "time", direction: str = "desc",
) -> None:
    """Every row of the filtered log in the chosen order, as CRLF files whose names give the order."""
    rows = with_outcome_flags(enrich_log(filters.apply(log), episodes, shows))
    ascending = str(direction).lower() == "asc"
    order = ["section", F.asc_nulls_first("key") if ascending else F.desc_nulls_last("key"), F.desc("id")]
    ordered = csv_lines(rows, sort).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("line").write.mode("errorifexists").option("lineSep", "\r\n").text(path)


def write_feeds(lines: DataFrame, path: str) -> None:
    """Feed documents, a folder per slug.

    Lines are range-partitioned in document order, so a large document is several files whose
    names give the order, and no task holds a whole one.
    """
    order = document_order()
    ordered = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select("slug", "line").write.mode("errorifexists").partitionBy("slug").text(path)
