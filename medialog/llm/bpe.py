"""Byte-pair encoding of words over a trie, and decoding.

For a word read symbol by symbol, the last token of every prefix's encoding is enough: the
encoding of a prefix is that of the prefix without its last token, and that token. A token may
come last if it ends the prefix, encodes to itself, and holds beside the last token before it
(no merge across their boundary would have come first). Just one does.

Distinct words go into a trie, so that a prefix shared by many words is worked out once, on the way
down. The last symbol of a word carries the word-end mark and is an edge of its own.

A text is cut at ASCII white space, which no token spans, and each worker process keeps the
encodings of pieces that it has met.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.llm.common import as_bytes, prepared, row_hash, slices, worker_tables
from medialog.llm.vocabulary import COMPOSED, read_vocabulary, shown, tokenizer

# Bytes of a worker's cache of pieces, and of its cache of words; entries of its cache of token pairs.
CACHE_BYTES = 64 << 20
CACHED_PAIRS = 200_000
# Bytes of text whose words share a trie; a longer text has one of its own.
SLICE = 2 << 20

_BASE = -1  # rank of a token that no merge makes
_WORD = 0  # key of a trie node that ends a word


class Merges:
    """The rules of a vocabulary."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank_of_pair = {(self.ids[a], self.ids[b]): r for r, (a, b) in enumerate(pairs)}
        self.rank, self.parts = [_BASE] * (max(self.ids.values()) + 1), {}
        for r, (a, b) in enumerate(pairs):
            made = self.ids[a + b]
            if self.rank[made] == _BASE:
                self.rank[made], self.parts[made] = r, (self.ids[a], self.ids[b])
        #: Tokens that encode to themselves.
        self.whole = {t: i for t, i in self.ids.items() if self.merged(self.symbols(t)) == [i]}
        #: What these begin with, cut between symbols.
        self.starts = {"".join(s[:k]) for s in map(self.symbols, self.whole) for k in range(1, len(s) + 1)}
        self.holds_cache: dict[int, bool] = {}

    def symbols(self, token: str) -> list[str]:
        """Characters, the last with the word-end mark if it has one."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            bare = token[: -len(self.end)]
            return [*bare[:-1], bare[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[int]:
        """Plain encoding: the best pair first, the leftmost of equals."""
        out = [self.ids.get(s, -1) for s in symbols]
        while len(out) > 1:
            rank, k = min((self.rank_of_pair.get(p, 1 << 60), k) for k, p in enumerate(zip(out, out[1:], strict=False)))
            if rank == 1 << 60:
                break
            out[k : k + 2] = [self.ids[self._text(out[k]) + self._text(out[k + 1])]]
        return out

    def _text(self, token: int) -> str:
        if not hasattr(self, "_texts"):
            self._texts = {i: t for t, i in self.ids.items()}
        return self._texts[token]

    def holds(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart: their merges are undone from the last back, and no merge
        across the boundary may come before the one undone."""
        key = left << 32 | right
        known = self.holds_cache.get(key)
        if known is None:
            known = self.holds_cache[key] = self._holds(left, right)
        return known

    def _holds(self, left: int, right: int) -> bool:
        before = 1 << 60
        while True:
            if self.rank_of_pair.get((left, right), before) < before:
                return False
            if self.rank[left] > self.rank[right]:
                before = self.rank[left]
                left = self.parts[left][1]
            elif self.rank[right] == _BASE:
                return True
            else:
                # A tie goes to the left, so the merge across comes before its equal on the right.
                before = self.rank[right] + 1
                right = self.parts[right][0]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids, as bytes of 32-bit numbers, of distinct words, without the word-end mark, by one walk over their trie."""
        trie: dict = {}
        for word in words:
            node = trie
            for c in word[:-1]:
                node = node.setdefault(c, {})
            node.setdefault(word[-1] + self.end, {})[_WORD] = word
        out: dict[str, bytes] = {}
        whole, starts, holds, known = self.whole, self.starts, self.holds, self.holds_cache.get
        # Of the prefix on the way down, by depth: last token, its start in symbols.
        last, start = [0], [0]
        # Node, its depth, its text, and where the earliest token starts that may still be open.
        stack = [(child, 1, edge, 0) for edge, child in trie.items()]
        while stack:
            node, depth, text, low = stack.pop()
            while text[low:] not in starts:
                low += 1
            for begin in range(low, depth):
                found = whole.get(text[begin:])
                if found is not None:
                    if not begin:
                        break
                    apart = known(last[begin] << 32 | found)
                    if apart or apart is None and holds(last[begin], found):
                        break
            else:
                raise ValueError(f"no token ends {text!r}")
            del last[depth:], start[depth:]
            last.append(found)
            start.append(begin)
            for edge, child in node.items():
                if edge is _WORD:
                    tokens, at = [found], begin
                    while at:
                        tokens.append(last[at])
                        at = start[at]
                    tokens.reverse()
                    out[child] = array("i", tokens).tobytes()
                else:
                    stack.append((child, depth + 1, text + edge, low))
        return out


# fixed: the split of this family of vocabularies before merges
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PIECES_AND_LINES = regex.compile(_PIECES.pattern + r"|\n")
_OTHER = regex.compile(f"[^{COMPOSED}]")


def _trim(cache: dict, most: int) -> None:
    """Forget the older half of a cache that has grown beyond ``most``."""
    if len(cache) > most:
        for key in list(islice(cache, len(cache) - most // 2)):
            del cache[key]


class Cache(dict):
    """Encodings by text, with the bytes they take, about."""

    held = 0

    def keep(self, pairs: Iterable[tuple]) -> None:
        for text, ids in pairs:
            self[text] = ids
            self.held += self.size(text, ids)

    @staticmethod
    def size(text: str | bytes, ids: bytes) -> int:
        return 2 * len(text) + len(ids) + 200

    def trim(self, most: int) -> None:
        """Forget the older part of what takes more than ``most`` bytes."""
        if self.held > most:
            for text in list(self):
                self.held -= self.size(text, self.pop(text))
                if self.held <= most // 2:
                    break


class Encoder:
    """Encodings in one worker process; ids are kept as the bytes of 32-bit numbers."""

    def __init__(self, vocabulary: str):
        self.merges, self.library = Merges(vocabulary), tokenizer(vocabulary)
        self.special = {x["content"]: np.int32(x["id"]).tobytes() for x in json.loads(vocabulary)["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.cache, self.words = Cache(), Cache()

    def split(self, text: str) -> list[str]:
        """Words of a text without special strings, in the vocabulary's byte letters."""
        if _OTHER.search(text):
            normal = self.library.normalizer.normalize_str(text)
            return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return [w if w.isascii() and w.isprintable() else shown(w) for w in _PIECES.findall(text.lower())]

    def parts(self, piece: str) -> list[str | bytes]:
        """Words, and the ids of special strings between them."""
        at, out = 0, []
        for m in self.cut.finditer(piece):
            out += [*self.split(piece[at : m.start()]), self.special[m.group()]]
            at = m.end()
        return out + self.split(piece[at:])

    def new_parts(self, pieces: list[bytes]) -> list[list[str | bytes]]:
        """:meth:`parts` of many pieces; those of plain characters are split in one go."""
        text = b"\n".join(pieces).decode()
        if _OTHER.search(text) or self.cut.search(text):
            return [self.parts(p.decode()) for p in pieces]
        out: list[list[str | bytes]] = [[]]
        for w in _PIECES_AND_LINES.findall(text.lower()):
            if w == "\n":
                out.append([])
            else:
                out[-1].append(w if w.isascii() and w.isprintable() else shown(w))
        return out

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        cache, words = self.cache, self.words
        cache.trim(CACHE_BYTES)
        words.trim(CACHE_BYTES)
        _trim(self.merges.holds_cache, CACHED_PAIRS)
        pieces = [t.split() for t in texts]
        new = list(set(chain.from_iterable(pieces)).difference(cache))
        found = []
        for k in range(0, len(new), 1000):
            found += self.new_parts(new[k : k + 1000])
        distinct = {w for parts in found for w in parts if type(w) is str}
        words.keep(self.merges.encode_words(distinct.difference(words)).items())
        cache.keep(
            (piece, words[parts[0]] if len(parts) == 1 and type(parts[0]) is str else b"".join([words[w] if type(w) is str else w for w in parts]))
            for piece, parts in zip(new, found, strict=True)
        )
        return [np.frombuffer(b"".join(map(cache.__getitem__, p)), dtype=np.int32) for p in pieces]


def _check(vocabulary: str) -> None:
    """Refuse vocabularies of another build than the one these rules are for."""
    spec = json.loads(vocabulary)
    model = spec["model"]
    if model["type"] != "BPE" or not model["end_of_word_suffix"] or model["continuing_subword_prefix"] or model["ignore_merges"] or model["dropout"]:
        raise ValueError("a BPE vocabulary with word ends is asked for")
    if any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"]):
        raise ValueError("special tokens that take in their surroundings are not handled")
    if spec["decoder"] or spec["post_processor"]:
        raise ValueError("a vocabulary without decoder and post-processor is asked for")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", and_decode: bool = False) -> DataFrame:
    """A row per row of ``docs``: ``id``, ``row`` (hash of the text), ``ids`` (array of int). With
    ``and_decode`` also ``text``, what :func:`decode` makes of the ids, in the same pass.

    ``path`` names a vocabulary with word ends of the tokenizers library on the driver. Null, empty
    and blank texts have no tokens. Repeated rows and null ids are rows like others; an empty table
    gives none.
    """
    spark = prepared(docs.sparkSession)
    vocabulary = read_vocabulary(path)
    _check(vocabulary)
    shared = spark.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, names = worker_tables("bpe", shared.value, lambda: Encoder(shared.value)), _names(shared.value)
        for batch in slices(batches, "text", SLICE):
            ids = rules.encode(as_bytes(batch.column("text")))
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *ids])))
            columns = [batch.column("id"), batch.column("row"), lists]
            yield pa.record_batch([*columns, _decoded(lists, names)] if and_decode else columns, ["id", "row", "ids", "text"][: 3 + and_decode])

    texts = docs.select(F.col(id_col).alias("id"), row_hash(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, row long, ids array<int>"
    return texts.mapInArrow(run, schema + ", text string" * and_decode)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``text``: the tokens' own strings joined by spaces, special ones included, as
    the library has it for a vocabulary without decoder. Null or empty ``ids`` give ''."""
    vocabulary = read_vocabulary(path)
    _check(vocabulary)
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(shared.value)
        for batch in batches:
            yield pa.record_batch([*batch.columns, _decoded(batch.column("ids"), names)], [*batch.schema.names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, text string")


@lru_cache(maxsize=2)
def _names(vocabulary: str) -> pa.Array:
    """The string of each token by id."""
    spec = json.loads(vocabulary)
    found = {i: t for t, i in spec["model"]["vocab"].items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
    return pa.array([found.get(i, "") for i in range(max(found) + 1)], pa.string())


def _decoded(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    """The names of each list joined by spaces."""
    lists = pa.ListArray.from_arrays(ids.offsets, names.take(ids.values))
    return pa.compute.fill_null(pa.compute.binary_join(lists, " "), "")
