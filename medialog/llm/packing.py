"""Documents packed into sequences of a fixed number of tokens, as few as can be.

A document is its tokens and an end token. One that is too long is cut into full pieces, its first
piece taking the rest; every other document is one piece. Only the number of pieces of each
length matters for the packing, and there are at most ``capacity`` lengths: a small table, however many
documents there are.

* Best fit decreasing over that table gives a first solution. It works on whole classes of equal
  sequences at once, with the same outcome as document by document.
* If that is above a lower bound (Martello and Toth's), bin completion looks for fewer: a branch
  takes the largest length left and enumerates the undominated fillings of the room beside it, tightest first, each
  as often as the table allows or once. Branches whose waste, or whose bound, cannot beat the best solution are cut.
* A solution is a list of fillings with how often each is used. Pieces are numbered within their length, and a piece's
  number says which filling, sequence and offset it gets.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.llm.common import prepared, row_hash, slices, worker_tables, written
from medialog.llm.running import running
from medialog.llm.token_counts import PRE_TOKENS
from medialog.llm.vocabulary import AGREED, byte_alphabet, read_vocabulary, tokenizer

CAPACITY = 1024
END_ID = 2
# Dead ends of a search for a better packing before it is given up; fillings tried at each node.
DEAD_ENDS = 60
FILLINGS = 32
# Fillings looked at for these, dominated ones included.
LOOKED = 500
# A search takes fillings with as much waste as a sequence may have on the average, times this, for equally good.
SLACKS = (4, 2, 1, 8, 0)
# Bytes of a worker's cache; characters of a chunk that is cached; of a text encoded at once.
CACHE_BYTES = 96 << 20
LONGEST = 200
PIECE = 1 << 20

Filling = tuple[tuple[int, int], ...]
Solution = list[tuple[Filling, int]]


# Lengths


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer sequences: by total, and by lengths that cannot stand together."""
    number = np.zeros(capacity + 1, np.int64)
    number[list(counts)] = list(counts.values())
    n, size = np.cumsum(number), np.cumsum(number * np.arange(capacity + 1))
    half, a = capacity // 2, np.arange(1, capacity // 2 + 1)
    alone, large = n[-1] - n[capacity - a], n[capacity - a] - n[half]
    room = large * capacity - (size[capacity - a] - size[half])
    more = np.maximum(0, size[half] - size[a - 1] - room)
    return max(-(-int(size[-1]) // capacity), int(np.max(alone + large - (-more // capacity), initial=0)))


def best_fit(counts: dict[int, int], capacity: int) -> Solution:
    """Best fit decreasing: each piece, longest first, goes where least room is left."""
    open_: dict[int, list[tuple[Filling, int]]] = {capacity: []}
    rooms: list[int] = []  # a heap of rooms with sequences, which may hold stale ones

    def put(room: int, filling: Filling, n: int) -> None:
        if room not in open_ or not open_[room]:
            open_[room] = []
            heapq.heappush(rooms, room)
        open_[room].append((filling, n))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        skipped = []
        while left and rooms:
            room = heapq.heappop(rooms)
            if not open_.get(room):
                continue
            if room < size:
                skipped.append(room)
                continue
            filling, n = open_[room].pop()
            each = min(room // size, left)
            used = min(n, left // each)
            if used < n:
                open_[room].append((filling, n - used))
            if open_[room]:
                heapq.heappush(rooms, room)
            put(room - each * size, (*filling, (size, each)), used)
            left -= each * used
        for room in skipped:
            heapq.heappush(rooms, room)
        each = capacity // size
        if left >= each:
            put(capacity - each * size, ((size, each),), left // each)
        if left % each:
            put(capacity - left % each * size, ((size, left % each),), 1)
    return [x for classes in open_.values() for x in classes]


def fillings(counts: dict[int, int], room: int, most: int, slack: int = 0) -> Iterator[Filling]:
    """The first ``most`` undominated fillings of ``room``: those that leave up to ``slack``, with the longest pieces
    first, then the rest by what they leave.

    A filling is dominated if a piece in it, or two together, could be exchanged for one longer piece
    that still fits: what is left over then packs no worse. Sums that the lengths from some place on can reach
    are kept as bits, so the search has no dead ends.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    reach = [1]
    for size in reversed(sizes):
        bits, n, step = reach[-1], min(counts[size], room // size), 1
        while n:
            step = min(step, n)
            bits |= bits << step * size
            n, step = n - step, 2 * step
        reach.append(bits & ((2 << room) - 1))
    reach.reverse()

    def reached(k: int, least: int, top: int) -> int:
        return reach[k] >> least & ((2 << top - least) - 1)

    def grow(k: int, least: int, top: int, chosen: Filling) -> Iterator[Filling]:
        while k < len(sizes) and top and reached(k, least, top):
            size = sizes[k]
            k += 1
            for n in range(min(counts[size], top // size), 0, -1):
                low, high = max(0, least - n * size), top - n * size
                if reached(k, low, high):
                    yield from grow(k, low, high, (*chosen, (size, n)))
        if not least:
            yield chosen

    found, looked, slack = 0, 0, min(slack, room)
    for least, top in [(room - slack, room), *((x, x) for x in range(room - slack - 1, -1, -1))]:
        for filling in grow(0, least, top, ()) if reached(0, least, top) else ():
            looked += 1
            left = room - sum(s * n for s, n in filling)
            if not _dominated(counts, sizes, left, filling):
                yield filling
                found += 1
            if found == most or looked > LOOKED and found:
                return
        if found and sizes and room - least >= sizes[0]:
            return  # any piece would still fit


def _dominated(counts: dict[int, int], sizes: list[int], left: int, chosen: Filling) -> bool:
    taken = dict(chosen)
    spare = sorted(s for s in sizes if counts[s] > taken.get(s, 0))
    if not spare:
        return False
    if spare[0] <= left:
        return True

    def longest(most: int) -> int:
        k = bisect_right(spare, most)
        return spare[k - 1] if k else 0

    single = list(taken)
    pairs = {a + b for i, a in enumerate(single) for b in single[i + (taken[a] < 2) :]}
    return any(longest(x + left) > x for x in single) or any(longest(x + left) >= x for x in pairs)


def _branches(state: dict[int, int], capacity: int, slack: int) -> Iterator[tuple[Filling, int]]:
    """What to do with the largest length left: a filling, as often as can be or once."""
    size = max(state)
    rest = {**state, size: state[size] - 1}
    for found in fillings(rest, capacity - size, FILLINGS, slack):
        whole = dict(found)
        whole[size] = whole.get(size, 0) + 1
        filling = tuple(sorted(whole.items(), reverse=True))
        for times in dict.fromkeys((min(state[s] // n for s, n in filling), 1)):
            yield filling, times


def pack(counts: dict[int, int], capacity: int = CAPACITY, dead_ends: int = DEAD_ENDS) -> Solution:
    """Fillings and how often each is used; all pieces in ``counts`` (how many of each length) once.

    With a search that ends before ``dead_ends`` dead ends, and few enough fillings at each node, the number of
    sequences is the least possible; else it is that of the best solution met.
    """
    counts = {s: n for s, n in counts.items() if n}
    best, bound = best_fit(counts, capacity), lower_bound(counts, capacity)
    for slack in SLACKS:
        fewest = sum(n for _, n in best)
        if fewest <= bound:
            break
        found, ended = _complete(counts, capacity, slack, fewest, bound, dead_ends)
        best = found or best
        if ended:
            break
    return best


def _complete(counts: dict[int, int], capacity: int, slack: float, fewest: int, bound: int, dead_ends: int) -> tuple[Solution, bool]:
    """Bin completion: a packing into fewer sequences than ``fewest``, or none, and whether the search ended."""
    state, best, path = dict(counts), [], []
    total = rest = sum(s * n for s, n in counts.items())
    seen: dict[int, int] = {}
    used = waste = 0

    def move(filling: Filling, times: int) -> None:
        nonlocal used, waste, rest
        held = sum(s * n for s, n in filling)
        for s, n in filling:
            state[s] = state.get(s, 0) - n * times
            if not state[s]:
                del state[s]
        used, waste, rest = used + times, waste + times * (capacity - held), rest - times * held

    def branches() -> Iterator[tuple[Filling, int]]:
        spare = (fewest - 1) * capacity - total - waste
        return _branches(state, capacity, int(slack * spare / (rest // capacity + 1)))

    stack = [branches()]
    while stack and dead_ends:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path:
                filling, times = path.pop()
                move(filling, -times)
            continue
        move(*step)
        path.append(step)
        # One sequence fewer than now can waste so much; a state met before with as few sequences is no better.
        hopeless = waste > (fewest - 1) * capacity - total
        if not hopeless and not state:
            best, fewest, hopeless = list(path), used, True
            if fewest <= bound:
                return best, True
        elif not hopeless:
            key = hash(frozenset(state.items()))
            hopeless = seen.get(key, used + 1) <= used or used + lower_bound(state, capacity) >= fewest
            seen[key] = used
        if hopeless:
            dead_ends -= 1
            path.pop()
            move(step[0], -step[1])
        else:
            stack.append(branches())
    return best, not stack


# Tokens


def ranks_of(vocabulary: str) -> dict[bytes, int] | None:
    """Ids by bytes, if merging the pair of least id gives what the library gives; else nothing.

    It does if merges come in the order of their ids and every token's own text becomes that token: two parts that make up a token
    without being its merge then never stand side by side, as this token's text would have stopped there too.
    """
    spec = json.loads(vocabulary)
    model, ids = spec["model"], spec["model"]["vocab"]
    split = spec.get("pre_tokenizer") or {}
    plain = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    if not plain or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    merged = [ids["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    added = {x["content"] for x in spec["added_tokens"]}
    tokens = {t: i for t, i in ids.items() if t not in added}
    library = tokenizer(vocabulary).model
    if merged != sorted(merged) or any([x.id for x in library.tokenize(t)] != [i] for t, i in tokens.items()):
        return None
    back = {c: b for b, c in byte_alphabet().items()}
    return {bytes(back[c] for c in t): i for t, i in tokens.items()}


class Encoder:
    """Token ids of texts as the library gives them.

    Texts are merged by ``ranks`` where these do as the library does and all characters are of one class in every
    Unicode version. Others go to the library by chunks that start at a space, which are kept, up to a number of bytes. A
    space between two characters that are not white space starts a new pre-token in byte-level vocabularies, so chunks, and blocks of a
    long text, are encoded apart.
    """

    def __init__(self, vocabulary: str, ranks: dict[bytes, int] | None = None):
        self.library = tokenizer(vocabulary)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.merger = ranks and tiktoken.Encoding("ranks", pat_str=PRE_TOKENS.pattern, mergeable_ranks=ranks, special_tokens={})
        self.cache = _Cache(self.encoded)

    def encoded(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self.special and self.special.search(text):
            return self.encoded(text)
        if len(text) <= PIECE:
            return self._block(text)
        out, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, at + PIECE)
            end = cut.start() if cut else len(text)
            out.append(self._block(text[at:end]))
            at = end
        return b"".join(out)

    def _block(self, text: str) -> bytes:
        if self.merger and not _OTHER.search(text):
            return self.merger.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
        chunks = _SPACE.split(text) if "  " in text else text.split(" ")
        first = self.cache[chunks[0]] if chunks[0] else b""
        return first + b"".join(map(self.cache.__getitem__, [" " + c for c in chunks[1:]]))


_SPACE = re.compile(r"(?<=\S) (?=\S)")
_OTHER = re.compile(f"[^{AGREED}]")


class _Cache(dict):
    def __init__(self, make):
        self.make, self.bytes = make, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.make(chunk)
        if len(chunk) <= LONGEST:
            self.bytes += 4 * len(chunk) + len(ids) + 200
            if self.bytes > CACHE_BYTES:
                self.clear()
                self.bytes = 0
            self[chunk] = ids
        return ids


_PIECES = ["id", "row", "nth", "piece", "start", "length", "ids_crc32"]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """A row per piece: ``id``, ``row`` (hash of the text), ``nth`` (tells rows of ``docs`` apart), ``piece``, ``start``,
    ``length``, ``ids_crc32``. Written to the shared folder."""
    spark = prepared(docs.sparkSession)
    vocabulary = read_vocabulary(path)
    name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast((vocabulary, ranks_of(vocabulary)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_tables("packing", name, lambda: Encoder(*shared.value))
        end, done = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            place, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = (encoder.ids(text) if text else b"") + end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    place.append(k)
                    piece.append(i)
                    start.append(a)
                    length.append(b - a)
                    crc.append(crc32(ids[4 * a : 4 * b]))
            rows = pa.array(place, pa.int64())
            nth = pa.array(done + np.array(place, np.int64))
            done += batch.num_rows
            yield pa.record_batch(
                [batch.column("id").take(rows), batch.column("row").take(rows), nth, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                _PIECES,
            )

    texts = docs.select(F.col(id_col).alias("id"), row_hash(text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    return written(texts.mapInArrow(cut, f"id {kind}, row long, nth long, piece int, start long, length long, ids_crc32 long"), "pieces")


class Places:
    """Where the pieces of each length go, by their number within the length."""

    def __init__(self, solution: Solution):
        entries: dict[int, list[tuple[int, int, int, int]]] = {}
        first = 0
        for filling, times in solution:
            offset = 0
            for size, each in filling:
                entries.setdefault(size, []).append((each * times, first, offset, each))
                offset += size * each
            first += times
        self.of = {}
        for size, rows in entries.items():
            n, base, offset, each = np.array(rows, np.int64).T
            self.of[size] = (np.concatenate([[0], np.cumsum(n)]), base, offset, each)

    def find(self, size: int, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces ``number``, from 0, of a length."""
        begins, base, offset, each = self.of[size]
        k = np.searchsorted(begins, number, side="right") - 1
        within = number - begins[k]
        return base[k] + within // each[k], offset[k] + within % each[k] * size


def pack_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, dead_ends: int = DEAD_ENDS
) -> DataFrame:
    """A row per piece: ``id``, ``row``, ``nth``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    ``path`` names a byte-level vocabulary of the tokenizers library on the driver. Null and empty
    texts are their end token. Rows without an id, and repeated rows, are documents like others,
    told apart by ``nth``; an empty table gives no rows.
    """
    spark = prepared(docs.sparkSession)
    cut = pieces(docs, path, id_col, text_col, capacity, end_id)
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    numbered = running(cut.withColumnRenamed("nth", "document"), "length", ["document", "piece"])
    places = spark.sparkContext.broadcast(Places(pack(lengths, capacity, dead_ends)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, number = batch.column("length").to_numpy(), batch.column("nth").to_numpy() - 1
            sequence, offset = np.empty_like(size), np.empty_like(size)
            for s in np.unique(size).tolist():
                own = size == s
                sequence[own], offset[own] = places.value.find(s, number[own])
            kept = [batch.column("document" if c == "nth" else c) for c in _PIECES]
            yield pa.record_batch([*kept, pa.array(sequence), pa.array(offset)], [*_PIECES, "sequence_id", "offset"])

    kind = cut.schema["id"].dataType.simpleString()
    schema = f"id {kind}, row long, nth long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.mapInArrow(place, schema)
