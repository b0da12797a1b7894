"""Token counts by a map-side lookup of pre-tokens in two tiers.

Tier one is a table of frequent pre-tokens with their lengths in tokens, made from a bounded
sample of documents and broadcast. Tier two is a cache in each worker process; a pre-token in
neither is encoded once and kept. No pre-token is shuffled. The tables only save work: every count is
that of the library.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.llm.common import prepared, row_hash, worker_tables
from medialog.llm.vocabulary import AGREED, read_vocabulary, shown, tokenizer

# Documents in the sample, pre-tokens in the table, entries in a worker's cache.
SAMPLE_DOCS = 1_000
FREQUENT = 30_000
# Characters of a pre-token in the table; longer ones are left to the workers' caches.
LONGEST = 100
CACHED = 400_000

# fixed: the split of byte-level vocabularies before merges
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_OTHER = regex.compile(f"[^{AGREED}]")


class Frequent:
    """Pre-tokens joined into one string, with their ends and lengths: a few bytes each."""

    def __init__(self, lengths: dict[str, int]):
        self.text = "".join(lengths)
        self.ends = np.cumsum([len(k) for k in lengths], dtype=np.int64)
        self.tokens = np.fromiter(lengths.values(), dtype=np.int64, count=len(lengths))

    def table(self) -> dict[str, int]:
        ends = self.ends.tolist()
        return {self.text[a:b]: n for a, b, n in zip([0, *ends], ends, self.tokens.tolist(), strict=False)}


class Counts:
    """Lengths of pre-tokens in one worker process."""

    def __init__(self, vocabulary: str, frequent: Frequent):
        self.tokenizer = tokenizer(vocabulary)
        self.frequent, self.cache = frequent.table(), {}
        added = [x["content"] for x in json.loads(vocabulary)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def of(self, text: str) -> int:
        if _OTHER.search(text) or self.special and self.special.search(text):
            return self.whole(text)
        first, second = self.frequent.get, self.cache
        total = 0
        for piece in PRE_TOKENS.findall(text):
            n = first(piece) or second.get(piece)
            if n is None:
                n = second[piece] = self.one(piece)
            total += n
        if len(second) > CACHED:
            second.clear()
        return total

    def one(self, piece: str) -> int:
        return len(self.tokenizer.model.tokenize(shown(piece)))


def frequent_pre_tokens(docs: DataFrame, text_col: str, vocabulary: str, sample_docs: int = SAMPLE_DOCS, most: int = FREQUENT) -> Frequent:
    """Lengths of the most frequent pre-tokens of about ``sample_docs`` documents, drawn row by row.

    Copies of a text are drawn each on its own, so that they do not enter the sample as a whole. Tasks send at most ``most`` counts each, and only those that read a chosen document send any.
    """
    chosen = docs.select(F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    share = min(1.0, sample_docs / max(1, docs.count()))
    sample = chosen.where(F.rand(7) < share) if share < 1 else chosen

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            texts = [t for t in batch.column("text").to_pylist() if not _OTHER.search(t)]
            counts.update(p for p in chain.from_iterable(map(PRE_TOKENS.findall, texts)) if len(p) <= LONGEST)
        pairs = counts.most_common(most)
        if pairs:
            yield pa.record_batch([pa.array([p for p, _ in pairs], pa.string()), pa.array([n for _, n in pairs], pa.int64())], ["piece", "n"])

    counts: Counter[str] = Counter()
    for piece, n in sample.mapInArrow(top, "piece string, n long").where("n > 1").collect():
        counts[piece] += n
    model = tokenizer(vocabulary).model
    return Frequent({piece: len(model.tokenize(shown(piece))) for piece, _ in counts.most_common(most)})


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: ``id``, ``row`` (hash of the text), ``n_bytes``, ``n_tokens``.

    ``path`` names a byte-level BPE vocabulary of the tokenizers library on the driver. Strings
    of added tokens inside texts count as the library has them. Null and empty texts have none.
    Repeated rows and null ids are rows like others; an empty table gives none.
    """
    spark = prepared(docs.sparkSession)
    vocabulary = read_vocabulary(path)
    name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(vocabulary)
    frequent = spark.sparkContext.broadcast(frequent_pre_tokens(docs, text_col, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = worker_tables("token counts", name, lambda: Counts(shared.value, frequent.value))
        for batch in batches:
            text = batch.column("text")
            n = [counts.of(t) if t else 0 for t in text.to_pylist()]
            size = pa.compute.fill_null(pa.compute.binary_length(text), 0).cast(pa.int64())
            yield pa.record_batch([batch.column("id"), batch.column("row"), size, pa.array(n, pa.int64())], ["id", "row", "n_bytes", "n_tokens"])

    texts = docs.select(F.col(id_col).alias("id"), row_hash(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, row long, n_bytes long, n_tokens long")
