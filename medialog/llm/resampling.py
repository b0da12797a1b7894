"""Documents drawn towards a target distribution: importance weights, Gumbel keys, an exact top share.

Hashed runs of words are counted in the documents and in the target. A bucket's gain is a
log ratio of the two; a document's weight is the sum of gains over its features, looked up in an
array. Weight plus Gumbel noise is its key, and the highest keys are drawn without replacement.

The cutoff among the keys is found by weighted median of medians: each partition gives the median of
its keys still in question and their number; the weighted median of these splits the keys, and at least
a quarter of them is settled in every round, until one key is left that has exactly as many above it
as are drawn. A round moves a few numbers a partition. Only the drawn rows are sorted.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.llm.common import as_bytes, prepared, row_hash, slices, written
from medialog.llm.decontaminate import words_of
from medialog.llm.running import running

RUNS = 1
BUCKETS = 10_000
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10
# Bytes of a text whose words are held at once.
PIECE = 1 << 20
_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def features(text: bytes, runs: int) -> Iterator[tuple[int, list[bytes]]]:
    """New words and the runs of 1 to ``runs`` words that end in them, a piece of the text at a time."""
    at, before = 0, []
    while at < len(text):
        stop = _BREAK.search(text, at + PIECE)
        end = stop.start() if stop else len(text)
        fresh = words_of(text[at:end])
        words, at = before + fresh, end
        old = len(before)
        yield len(fresh), fresh if runs == 1 else [b" ".join(words[k - n : k]) for n in range(1, runs + 1) for k in range(max(n, old + 1), len(words) + 1)]
        before = words[-(runs - 1) :] if runs > 1 else []


def buckets_of(texts: list[bytes], runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The buckets of the features of all texts in order; by text the number of features and of words."""
    parts, sizes, words = [], [], []
    for text in texts:
        found = list(features(text, runs))
        parts += [f for _, f in found]
        sizes.append(sum(len(f) for _, f in found))
        words.append(sum(n for n, _ in found))
    hashes = np.fromiter(map(crc32, chain.from_iterable(parts)), np.uint32, sum(sizes))
    return hashes % np.uint32(buckets), np.array(sizes, np.int64), np.array(words, np.int64)


def bucket_counts(docs: DataFrame, text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows by bucket: summed in each task, then over tasks; ``buckets`` numbers come back."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(buckets_of(as_bytes(batch.column("text")), runs, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, by bucket."""
    n = len(source)
    s, t = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((a + 1.0) * s / ((b + 1.0) * t))) for a, b in zip(target.tolist(), source.tolist(), strict=True)], np.int64)


def gumbel(name: str) -> int:
    """Thousandths of a Gumbel number, from the hash of a name."""
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = ["id", "row", "nth", "n_words", "n_features", "weight", "score"]


def scored(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, buckets: int = BUCKETS, seed: str = SEED
) -> DataFrame:
    """A row per row of ``docs``: ``id``, ``row`` (hash of the text), ``nth`` (tells all rows apart), ``n_words``,
    ``n_features``, ``weight``, ``score``. Written to the shared folder.
    """
    spark = prepared(docs.sparkSession)
    table = gains(bucket_counts(target, "text", runs, buckets), bucket_counts(docs, text_col, runs, buckets))
    shared = spark.sparkContext.broadcast(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, done = shared.value, TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            bucket, size, words = buckets_of(as_bytes(batch.column("text")), runs, buckets)
            total = np.concatenate([[0], np.cumsum(gain[bucket])])
            ends = np.cumsum(size)
            weight = total[ends] - total[ends - size]
            noise = np.array([gumbel(f"{seed}:{'' if i is None else i}") for i in batch.column("id").to_pylist()], np.int64)
            nth = done + np.arange(batch.num_rows)
            done += batch.num_rows
            numbers = [pa.array(x, pa.int64()) for x in (nth, words, size, weight, weight + noise)]
            yield pa.record_batch([batch.column("id"), batch.column("row"), *numbers], _SCORED)

    texts = docs.select(F.col(id_col).alias("id"), row_hash(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return written(texts.mapInArrow(score, f"id {kind}, " + ", ".join(f"{c} long" for c in _SCORED[1:])), "scored")


# The order of keys: highest score, then smallest id (none last), then hash and place of the row.
_KEY = ["score", "id", "row", "nth"]


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row"), F.col("nth")]


def _rank(key: tuple) -> tuple:
    score, id_, row, nth = key
    return (-score, id_ is None, 0 if id_ is None else id_, row, nth)


def _before(key: tuple) -> Column:
    """Rows that come before ``key``."""
    score, id_, row, nth = key
    i, r = F.col("id"), F.col("row")
    rest = (r < row) | ((r == row) & (F.col("nth") < nth))
    same = i.isNull() if id_ is None else i.eqNullSafe(F.lit(id_))
    sooner = i.isNotNull() if id_ is None else F.coalesce(i < F.lit(id_), F.lit(False))
    return (F.col("score") > score) | ((F.col("score") == score) & (sooner | (same & rest)))


def _medians(pivot: tuple | None):
    """By partition: how many keys come before and after the pivot, and the medians of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        keys = pa.Table.from_batches(held)
        order = pa.compute.sort_indices(keys, sort_keys=[("score", "descending"), ("id", "ascending"), ("row", "ascending"), ("nth", "ascending")])

        def at(k: int) -> tuple:
            j = order[k].as_py()
            return tuple(keys.column(c)[j].as_py() for c in _KEY)

        low, high = 0, len(order)
        if pivot is not None:
            while low < high:  # the first key that is not before the pivot
                mid = (low + high) // 2
                low, high = (mid + 1, high) if _rank(at(mid)) < _rank(pivot) else (low, mid)
        own = low < len(order) and pivot is not None and at(low) == pivot
        for side, start, stop in ((0, 0, low), (1, low + own, len(order))):
            if start < stop:
                key = at((start + stop) // 2)
                types = [keys.schema.field(c).type for c in _KEY]
                yield pa.record_batch(
                    [pa.array([side], pa.int64()), pa.array([stop - start], pa.int64()), *(pa.array([x], t) for x, t in zip(key, types, strict=True))],
                    ["side", "n", *_KEY],
                )

    return run


def _middle(medians: list[tuple[tuple, int]]) -> tuple:
    """The weighted median of medians."""
    half, done = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians, key=lambda x: _rank(x[0])):
        done += n
        if done >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, wanted: int) -> tuple:
    """The key (``score``, ``id``, ``row``, ``nth``) that is number ``wanted``, from 1, of all keys in order."""
    keys = keys.select(*_KEY)
    schema = f"side long, n long, score long, id {keys.schema['id'].dataType.simpleString()}, row long, nth long"

    def ask(pivot: tuple | None) -> list[list[tuple[tuple, int]]]:
        sides: list[list[tuple[tuple, int]]] = [[], []]
        for r in window.mapInArrow(_medians(pivot), schema).collect():
            sides[r.side].append((tuple(r[c] for c in _KEY), r.n))
        return sides

    window, stored = keys, None
    medians = ask(None)[1]
    left = stored = sum(n for _, n in medians)
    if not 1 <= wanted <= left:
        raise ValueError(f"no key number {wanted} of {left}")
    while True:
        pivot = _middle(medians)
        before, after = ask(pivot)
        n = sum(x for _, x in before)
        if wanted == n + 1:
            return pivot
        if wanted <= n:
            medians, window = before, window.where(_before(pivot))
        else:
            medians, wanted, window = after, wanted - n - 1, window.where(~_before(pivot) & (F.col("nth") != pivot[3]))
        left = sum(x for _, x in medians)
        if left * 4 < stored:  # what is settled is not read again
            window, stored = written(window, "keys"), left


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    runs: int = RUNS,
    buckets: int = BUCKETS,
    seed: str = SEED,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """A row per row of ``docs``: ``id``, ``row``, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank``.

    Of the rows with at least ``min_words`` words, ``percent`` of a hundred, rounded down, are drawn by
    highest score, ties by smallest id, rows without an id last, then by hash of the text; ``rank`` counts them from 1 and is null
    for the rest. ``target`` has a column ``text``. Null and empty texts have no words and weight 0; repeated rows
    count each. An empty target or table is a count of zeros; without documents there are no rows.
    """
    every = scored(docs, target, id_col, text_col, runs, buckets, seed)
    able = F.col("n_words") >= min_words
    wanted = percent * every.where(able).count() // 100
    columns = ["id", "row", "n_words", "n_features", "weight", "score"]
    unranked = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return every.select(*columns, unranked)
    last = cutoff(every.where(able), wanted)
    drawn = able & (_before(last) | (F.col("nth") == last[3]))
    ranked = running(every.where(drawn).withColumnRenamed("nth", "place").withColumn("one", F.lit(0).cast("long")), "one", [*_order()[:3], F.col("place")])
    return every.where(~drawn).select(*columns, unranked).unionByName(ranked.select(*columns, F.col("nth").alias("rank")))
