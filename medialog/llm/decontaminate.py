"""Passages of benchmark items in documents, by Wu-Manber multi-pattern search over words.

An item gives its windows of ``WINDOW`` consecutive words, or one window if it is shorter.
Windows of one length form a table: for every block of two words the distance that the search may
move on, and for blocks that end a window the windows to compare. The text is read at the
place where a window would end; most places are passed over without being looked at. Every match
is confirmed by comparing all words.

Windows are made in Spark and handed to the tasks in blocks of at most ``BLOCK`` windows; with more
of them the documents are searched once a block and the spans united by document.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.llm.common import as_bytes, filter_texts, prepared, row_hash, written

WINDOW = 10
BLOCK = 200_000

# Other bytes than digits, ASCII letters and those of non-ASCII characters become spaces; A-Z become a-z.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch.column("item").to_pylist(), as_bytes(batch.column("text")), strict=True):
                words = words_of(text)
                for k in range(max(1, len(words) - width + 1) if words else 0):
                    ids.append(item)
                    out.append(b" ".join(words[k : k + width]))
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(out, pa.binary()).cast(pa.string())], ["item", "window"])

    return run


class Patterns:
    """Shift table and suffix buckets of windows of one length."""

    def __init__(self, length: int, windows: dict[tuple[bytes, ...], list[str]]):
        self.length, self.size = length, min(2, length)
        #: Moves allowed after a block that no window holds.
        self.far = length - self.size + 1
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, list[tuple[list[bytes], list[str]]]] = defaultdict(list)
        for words, items in windows.items():
            for end in range(self.size, length + 1):
                block = b" ".join(words[end - self.size : end])
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.bucket[b" ".join(words[length - self.size :])].append((list(words), items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Start of every occurrence, with the items that have the window."""
        shift, far, length, pairs = self.shift.get, self.far, self.length, self.size == 2
        end, last = length - 1, len(words)
        while end < last:
            block = words[end - 1] + b" " + words[end] if pairs else words[end]
            move = shift(block, far)
            if move:
                end += move
                continue
            start = end - length + 1
            for window, items in self.bucket[block]:
                if words[start] == window[0] and words[start : end + 1] == window:
                    yield start, items
            end += 1


def compile_patterns(rows: list[tuple[str, list[str | None]]]) -> list[Patterns]:
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = defaultdict(dict)
    for window, items in rows:
        words = tuple(window.encode().split(b" "))
        by_length[len(words)][words] = [x for x in items if x is not None]
    return [Patterns(n, windows) for n, windows in sorted(by_length.items())]


def spans_in(words: list[bytes], patterns: list[Patterns]) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges under any occurrence, merged, and the items found."""
    found: list[tuple[int, int]] = []
    items: set[str] = set()
    for p in patterns:
        for start, names in p.search(words):
            found.append((start, start + p.length))
            items.update(names)
    merged: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if merged and start <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged, items


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _compiled(shared)
        for batch in batches:
            counts, spans, items = [], [], []
            for text in as_bytes(batch.column("text")):
                words = words_of(text)
                where, names = spans_in(words, patterns)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in where])
                items.append(sorted(names))
            yield pa.record_batch(
                [batch.column("id"), batch.column("row"), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))],
                ["id", "row", "n_words", "spans", "items"],
            )

    return run


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct windows with the items that have them; items without words give none."""
    texts = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    pairs = texts.mapInArrow(_windows(width), "item string, window string").distinct()
    return pairs.groupBy("window").agg(F.collect_list("item").alias("items"))


def _shared_block(windows: DataFrame, part: int, blocks: int) -> Broadcast:
    """One block of windows, of ``BLOCK`` or so, sent to all tasks."""
    rows = windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == part).collect()
    return windows.sparkSession.sparkContext.broadcast([(r[0], list(r[1])) for r in rows])


_last: list = [None, []]


def _compiled(shared: Broadcast) -> list[Patterns]:
    """The tables of a block, made once a worker process."""
    if _last[0] is not shared.value:
        _last[:] = [shared.value, compile_patterns(shared.value)]
    return _last[1]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """A row per row of ``docs``: ``id``, ``row``, ``n_words``, ``spans`` (merged word ranges under a
    window, end excluded), ``items`` (ids, as strings, of items with a window there, sorted).

    Null and empty texts have no words. Items without an id mark their passages but are not
    listed. Repeated documents and items change nothing else. Without items nothing is found.
    """
    prepared(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), row_hash(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    windows = written(benchmark_windows(benchmark, "item_id", "text", width), "windows")
    blocks = max(1, math.ceil(windows.count() / block))
    id_type = texts.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, row long, n_words long, spans array<struct<start: int, end: int>>, items array<string>"

    def searched(part: int) -> DataFrame:
        return texts.mapInArrow(_search(_shared_block(windows, part, blocks)), schema)

    if blocks == 1:
        return searched(0)
    # Each row of docs comes once a block; rows repeated with id and text hold the same.
    every = searched(0).withColumn("copy", F.lit(0))
    for part in range(1, blocks):
        every = every.unionByName(searched(part).withColumn("copy", F.lit(part)))
    united = every.groupBy("id", "row").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("copy") == 0, 1).otherwise(0)).cast("int").alias("rows"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    merged = F.aggregate(
        "spans",
        F.expr("cast(array() as array<struct<start: int, end: int>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    again = united.withColumn("again", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return again.select("id", "row", "n_words", merged.alias("spans"), "items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with all their columns."""
    prepared(docs.sparkSession)
    windows = written(benchmark_windows(benchmark, "item_id", "text", width), "windows")
    blocks = max(1, math.ceil(windows.count() / block))
    for part in range(blocks):
        cleaned = filter_texts(docs, _clean(_shared_block(windows, part, blocks)), text_col)
        docs = written(cleaned, "clean") if blocks > 1 else cleaned
    return docs


def _clean(shared: Broadcast):
    def keeps(texts: list[bytes]) -> list[bool]:
        patterns = _compiled(shared)
        return [not any(next(p.search(words), None) for p in patterns) for words in map(words_of, texts)]

    return keeps
