"""What the operators share: tables, written intermediate results, row keys, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Texts are handed to Python in batches of at most so many rows and bytes.
BATCH_ROWS = 2_000
BATCH_BYTES = "16m"

# Bits of the filter of :func:`bit_filter`: 8 MB at most, whatever the input.
FILTER_BITS = 1 << 26
_BUCKET_BITS = 32_768


def prepared(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_path(spark: SparkSession, purpose: str) -> str:
    """A new folder that the driver and all executors share.

    Its parent is ``spark.checkpoint.dir``. Only a local session may go without.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="llm-")
    return f"{root.rstrip('/')}/llm/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, safe from lost executors."""
    path = shared_path(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_tables: dict = {}


def worker_tables(owner: str, key, make: Callable[[], object]):
    """Tables of a worker process that outlive a task. It holds those of one operator at a time."""
    if _tables.get("of") != (owner, key):
        forget_tables()
        _tables.update({"of": (owner, key), "tables": make()})
    return _tables["tables"]


def forget_tables() -> None:
    """Let go of what an earlier operator left in this worker process, memory that Arrow holds in reserve included."""
    _tables.clear()
    pa.default_memory_pool().release_unused()


def row_hash(text: str) -> Column:
    """Tells rows apart that share an id, or have none."""
    return F.xxhash64(F.col(text))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, in any case of letters."""
    taken, lead = {c.lower() for c in df.columns}, "__"
    while any(f"{lead}{n}" in taken for n in names):
        lead += "_"
    return [f"{lead}{n}" for n in names]


def pick_rows(docs: DataFrame, chosen: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` named in ``chosen`` (``id``, ``row``), each once, with all columns.

    A row is named by its id, which may be null, and the hash of its text; rows alike in both
    are one row repeated. The window follows the partitioning and order of the join, so the
    texts move once.
    """

    *names, nth = free_names(docs, "id", "no_id", "row", "nth")

    def keys(id_: Column, row: Column) -> list[Column]:
        return [F.coalesce(id_.cast("string"), F.lit("")).alias(names[0]), id_.isNull().alias(names[1]), row.alias(names[2])]

    marked = docs.select("*", *keys(F.col(id_col), row_hash(text_col)))
    found = marked.join(chosen.select(*keys(F.col("id"), F.col("row"))), names, "left_semi")
    once = found.withColumn(nth, F.row_number().over(Window.partitionBy(*names).orderBy(*names)))
    return once.where(F.col(nth) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def filter_texts(docs: DataFrame, keeps: Callable[[list[bytes]], list[bool]], text_col: str = "text", most: int = 4 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose whole texts ``keeps`` approves; nothing moves."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_tables()
        for batch in slices(batches, place, most):
            yield batch.filter(pa.array(keeps(as_bytes(batch.column(place).cast(pa.string()))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def bit_filter(keys: DataFrame, hash_col: str) -> np.ndarray:
    """A filter of fixed size over 64-bit hashes: bit (hash mod ``FILTER_BITS``) is set.

    Hashes that are absent may be let through, none that is present is held back. What reaches
    the driver is at most ``FILTER_BITS / 8`` bytes.
    """
    spot = keys.select(F.pmod(F.col(hash_col), F.lit(FILTER_BITS)).alias("spot"))
    rows = (
        spot.groupBy(F.floor(F.col("spot") / _BUCKET_BITS).alias("bucket"))
        .agg(F.expr(f"bitmap_construct_agg(cast(spot % {_BUCKET_BITS} as int))").alias("bits"))
        .collect()
    )
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for bucket, bits in rows:
        start = int(bucket) * (_BUCKET_BITS // 8)
        out[start : start + len(bits)] = np.frombuffer(bytes(bits), dtype=np.uint8)
    return out


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which signed 64-bit hashes the filter lets through."""
    spot = hashes.astype(np.int64) & (FILTER_BITS - 1)
    return (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str | int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each come to ``most`` bytes or are a single row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
