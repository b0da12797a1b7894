"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are the same after all ASCII white space is deleted. Lengths and
hashes are those of the text without it.

1. One scan counts rows by length and hash of the first bytes; the counts are combined in
   each task before they move. Lengths of one row go, then prefixes of one row.
2. The prefixes that are left become a filter of fixed size. A second scan reads in full only the
   rows that it lets through, and gives them a SHA-256. What the filter lets through by chance
   ends as a group of one row.
3. Rows left are grouped by the full hash; only narrow rows move.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.llm.common import as_bytes, bit_filter, forget_tables, passes, pick_rows, prepared, row_hash, written

WHITE = b" \t\n\v\f\r"
PREFIX_BYTES = 64


def _prefix_hash(text: bytes) -> int:
    """Signed hash of length and first bytes."""
    return xxhash.xxh64_intdigest(text[:PREFIX_BYTES], seed=len(text) & 0xFFFFFFFF) - (1 << 63)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_tables()
    for batch in batches:
        bare = [t.translate(None, WHITE) for t in as_bytes(batch.column("text"))]
        yield pa.record_batch(
            [pa.array([len(t) for t in bare], pa.int64()), pa.array([_prefix_hash(t) for t in bare], pa.int64())],
            ["length", "prefix"],
        )


def _digests(bits, all_rows: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = bits.value
        for batch in batches:
            text = batch.column("text")
            bare = [t.translate(None, WHITE) for t in as_bytes(text)]
            prefix = np.array([_prefix_hash(t) for t in bare], dtype=np.int64)
            candidate = passes(known, prefix)
            digest = [hashlib.sha256(t).hexdigest() if all_rows or c else None for t, c in zip(bare, candidate, strict=True)]
            points = pa.compute.fill_null(pa.compute.utf8_length(text), 0).cast(pa.int64())
            yield pa.record_batch(
                [batch.column("id"), batch.column("row"), points, pa.array(candidate), pa.array(digest, pa.string())],
                ["id", "row", "points", "candidate", "digest"],
            )

    return run


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_digests: bool = False) -> DataFrame:
    """A row per row of ``docs``: ``id``, ``row`` (hash of the text as it is), ``keep_id``,
    ``group_size``, ``kept``, ``digest``.

    Of equal texts the one with the most code points stays, then the smallest id, a null id last.
    ``digest`` is null for rows that never needed one, unless ``all_digests``.

    Null and empty texts are equal, and equal to texts of white space. Rows repeated with id and
    text count each and share their decision. Rows without an id are told apart by their text.
    An empty table gives no rows. Other columns are not read.
    """
    spark = prepared(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), row_hash(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))

    shapes = texts.select("text").mapInArrow(_shapes, "length long, prefix long")
    counts = written(shapes.groupBy("length", "prefix").agg(F.count("*").alias("n")), "exact-shapes")
    lengths = counts.groupBy("length").agg(F.sum("n").alias("rows")).where("rows > 1")
    prefixes = counts.join(lengths, "length", "left_semi").where("n > 1")
    bits = spark.sparkContext.broadcast(bit_filter(prefixes, "prefix"))

    id_type = texts.schema["id"].dataType.simpleString()
    rows = written(
        texts.mapInArrow(_digests(bits, all_digests), f"id {id_type}, row long, points long, candidate boolean, digest string"),
        "exact-digests",
    )
    # The row that stays is the smallest of these; its id comes last but for the tie by text.
    rank = F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    groups = (
        rows.where("candidate")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.min(rank).alias("best"))
        .select("digest", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    )
    grouped = (
        rows.where("candidate")
        .join(groups, "digest")
        .select(
            "id", "row", "keep_id", "group_size",
            (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))).alias("kept"), "digest",
        )
    )
    alone = rows.where("not candidate").select(
        "id", "row", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest"
    )
    return grouped.unionByName(alone)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows repeated with id and text once."""
    kept = exact_duplicates(docs, id_col, text_col).where("kept").select("id", "row")
    return pick_rows(docs, kept, id_col, text_col)
