"""Conversations that begin alike, as a trie of their turns.

A node is a sequence of turns with which conversations begin. It is named by a digest of 128 bits: the sum
over its turns of a hash of place, role and text, so that a node's digest is its parent's plus one
number, and digests are running sums that combine over tasks. Texts are hashed where they are read and never move.

Paths (conversation, depth, digest) are worked on in shards of at most ``SHARD`` rows. A shard enumerates its distinct
digests and gives each a slot by a minimal perfect hash, verified against the digest that the slot holds. Counts are
scattered into flat arrays by slot. Sums over subtrees go up through an array of parent slots, deepest first. Shards see different
conversations or different stretches of one, so what they find about a node adds up, and one grouping by digest
unites them. Neither a common beginning nor a very long conversation has to fit into a task.

A sum over the distinct nodes below a node must count each of them once, in one shard. A node is counted with its
smallest member. The nodes that a conversation is smallest in are the end of its path; so a conversation has to know
only how many code points lie before them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.llm.common import prepared, slices, written
from medialog.llm.hashing import mixed
from medialog.llm.running import running

SHARD = 1 << 20
_PLACE_A, _PLACE_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_LEVEL = 0xA0761D6478BD642F


class NodeTable:
    """Slots 0 to n-1 for n distinct digests, without gaps.

    Level by level the digests still without a slot are thrown into twice as many places; those alone in
    theirs stay. A slot is the rank of a place among all that are taken. ``slots`` compares every
    digest with the one its slot holds.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        a, b = a[fresh], b[fresh]
        self.levels: list[np.ndarray] = []
        self.a, self.b = np.empty(len(a), np.uint64), np.empty(len(a), np.uint64)
        taken = 0
        while len(a):
            place = self._place(len(self.levels), a, b, 2 * len(a))
            ranks = np.bincount(place, minlength=2 * len(a)) == 1
            alone = ranks[place]
            rank = np.where(ranks, taken + np.cumsum(ranks) - 1, -1)
            self.levels.append(rank)
            self.a[rank[place[alone]]], self.b[rank[place[alone]]] = a[alone], b[alone]
            taken += int(ranks.sum())
            a, b = a[~alone], b[~alone]

    def __len__(self) -> int:
        return len(self.a)

    @staticmethod
    def _place(level: int, a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
        return (mixed(a ^ mixed(b + np.uint64((level + 1) * _LEVEL % (1 << 64)))) % np.uint64(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slots of digests, all of which must be in the table."""
        out, open_ = np.full(len(a), -1), np.arange(len(a))
        for level, rank in enumerate(self.levels):
            found = rank[self._place(level, a[open_], b[open_], len(rank))]
            out[open_] = found
            open_ = open_[found < 0]
        if len(open_) or (self.a[out] != a).any() or (self.b[out] != b).any():
            raise ValueError("a digest is not in the table")
        return out


# Paths


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        out, chars = bytearray(), []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            name, said = (role or "").encode(), (text or "").encode()
            out += hashlib.sha256(len(name).to_bytes(8, "little") + name + said).digest()[:16]
            chars.append(len(text or ""))
        words = np.frombuffer(bytes(out), "<i8").reshape(-1, 2)
        yield pa.record_batch(
            [batch.column("conv_id"), batch.column("turn"), batch.column("role"), *(pa.array(x) for x in (words[:, 0], words[:, 1], np.array(chars, np.int64)))],
            ["conv_id", "turn", "role", "a", "b", "chars"],
        )


def numbered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``place`` (from 1), ``a``, ``b`` (hash of role and text), ``chars`` of turns (``conv_id``, ``turn``, ``role``, ``text``).

    A null turn comes first, turns of one number follow by role, then by hash. A row without ``conv_id`` is
    of no conversation.
    """
    prepared(turns.sparkSession)
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.col("text").cast("string").alias("text")
    )
    kind = rows.schema["turn"].dataType.simpleString()
    hashed = written(rows.mapInArrow(_digest, f"conv_id long, turn {kind}, role string, a long, b long, chars long"), "turns")
    return running(hashed, "conv_id", ["turn", "role", "a", "b"]).select("conv_id", F.col("nth").alias("place"), "a", "b", "chars")


def rebuilt(numbered: DataFrame, of: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another one, and all their ids.

    Conversation c begins with the first h turns of conversation c - c % ``of`` (none if there is none) and goes on with its own after its
    first h; h is the CRC-32 of c in decimals, modulo ``most``.
    """

    def opening(c: Column) -> Column:
        return F.crc32(c.cast("string").cast("binary")) % most

    def donor(c: Column) -> Column:
        return c - c % of

    conv = F.col("conv_id")
    members = written(numbered.groupBy("conv_id").agg(F.max("place").alias("own")), "conversations")
    donors = numbered.where((donor(conv) == conv) & (F.col("place") < most))
    begun = members.select(conv, donor(conv).alias("donor")).join(donors.select(conv.alias("donor"), "place", "a", "b", "chars"), "donor").where(F.col("place") <= opening(conv))
    there = members.where(donor(conv) == conv).select(conv.alias("donor"), F.col("own").alias("there"))
    rest = numbered.where(F.col("place") > opening(conv)).withColumn("donor", donor(conv)).join(there, "donor", "left")
    moved = F.col("place") - opening(conv) + F.least(opening(conv), F.coalesce("there", F.lit(0)))
    columns = ["conv_id", "place", "a", "b", "chars"]
    return begun.select(*columns).unionByName(rest.withColumn("place", moved).select(*columns)), members.select("conv_id")


def _salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turn hashes made to depend on their place; a place 0 has nothing."""
    for batch in batches:
        place, a, b = (batch.column(c).to_numpy().view(np.uint64) for c in ("place", "a", "b"))
        used = place > 0
        a, b = np.where(used, mixed(a + place * _PLACE_A), np.uint64(0)), np.where(used, mixed(b ^ (place * _PLACE_B)), np.uint64(0))
        yield pa.record_batch([batch.column("conv_id"), batch.column("place"), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), batch.column("chars")], batch.schema.names)


_PATHS = "conv_id long, depth long, a long, b long, up_a long, up_b long, chars long, total long"


def _with_parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, run_a, run_b = (batch.column(c).to_numpy().view(np.uint64) for c in ("a", "b", "run_a", "run_b"))
        digests = [pa.array(x.view(np.int64)) for x in (run_a, run_b, run_a - a, run_b - b)]
        yield pa.record_batch(
            [batch.column("conv_id"), batch.column("place"), *digests, batch.column("chars"), batch.column("run_chars")],
            ["conv_id", "depth", "a", "b", "up_a", "up_b", "chars", "total"],
        )


def paths_of(numbered: DataFrame, members: DataFrame) -> DataFrame:
    """A row per conversation and depth, 0 included: the node's digest (``a``, ``b``), its parent's, code points of
    the node's last text (``chars``) and of all its texts (``total``)."""
    zero = F.lit(0).cast("long")
    roots = members.select("conv_id", zero.alias("place"), zero.alias("a"), zero.alias("b"), zero.alias("chars"))
    rows = numbered.select("conv_id", F.col("place").cast("long").alias("place"), "a", "b", "chars").unionByName(roots)
    salted = written(rows.mapInArrow(_salted, "conv_id long, place long, a long, b long, chars long"), "salted")
    return running(salted, "conv_id", ["place"], ["a", "b", "chars"]).mapInArrow(_with_parents, _PATHS)


# Shards


def _columns(held: list[pa.RecordBatch], names: tuple[str, ...]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(held)
    return {c: table.column(c).to_numpy() for c in names}


def _shards(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], shard: int) -> Iterator[dict[str, np.ndarray]]:
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= shard:
            yield _columns(held, names)
            held, rows = [], 0
    if held:
        yield _columns(held, names)


def _unsigned(x: dict[str, np.ndarray], *names: str) -> list[np.ndarray]:
    return [x[c].view(np.uint64) for c in names]


def _enumerate(shard: int):
    """The nodes of each shard: members counted by slot, smallest member, what the node's turns come to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _shards(batches, ("conv_id", "depth", "a", "b", "up_a", "up_b", "chars", "total"), shard):
            nodes = NodeTable(*_unsigned(x, "a", "b"))
            slot = nodes.slots(*_unsigned(x, "a", "b"))
            n = np.bincount(slot, minlength=len(nodes))
            least = np.full(len(nodes), np.iinfo(np.int64).max)
            np.minimum.at(least, slot, x["conv_id"])
            same = {c: np.empty(len(nodes), np.int64) for c in ("depth", "up_a", "up_b", "chars", "total")}
            for c, out in same.items():
                out[slot] = x[c]
            yield pa.record_batch(
                [*(pa.array(y.view(np.int64)) for y in (nodes.a, nodes.b)), pa.array(n), pa.array(least), *map(pa.array, same.values())],
                ["a", "b", "n", "conv_id", *same],
            )

    return run


def _accumulate(shard: int):
    """By node of a shard, sums over its subtree of what the shard's conversations count.

    A conversation counts a leaf if it is the smallest member of the leaf it ends in, and the code points of its path
    that lie before its own nodes. Where its path goes on outside the shard, the rest is added at the last row here. A stretch
    that begins below the root is summed by itself: it must not reach nodes that its conversation passes elsewhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _shards(batches, ("conv_id", "depth", "a", "b", "up_a", "up_b", "chars", "total", "unowned", "leaf"), shard):
            conv, depth, unowned = x["conv_id"], x["depth"], x["unowned"]
            rows = len(conv)
            begins = np.concatenate([[True], (conv[1:] != conv[:-1]) | (depth[1:] != depth[:-1] + 1)])
            ends = np.concatenate([begins[1:], [True]])
            saved = np.minimum(x["total"], unowned) - np.minimum(x["total"] - x["chars"], unowned)
            saved[ends] += np.maximum(0, unowned - x["total"])[ends]
            leaves = np.where(ends, x["leaf"], 0)
            start = np.maximum.accumulate(np.where(begins, np.arange(rows), 0))
            whole = depth[start] == 0
            if not whole.all():
                last = np.flatnonzero(ends)[np.cumsum(begins)[~whole] - 1]
                sums = []
                for value in (leaves, saved):
                    total = np.concatenate([[0], np.cumsum(value)])
                    sums.append(total[last + 1] - total[np.flatnonzero(~whole)])
                yield _sums(x["a"][~whole], x["b"][~whole], *sums)
            if whole.any():
                a, b, up_a, up_b = (y[whole] for y in _unsigned(x, "a", "b", "up_a", "up_b"))
                nodes = NodeTable(a, b)
                slot, at = nodes.slots(a, b), depth[whole]
                below = at > 0
                parent, level = np.full(len(nodes), -1), np.zeros(len(nodes), np.int64)
                parent[slot[below]] = nodes.slots(up_a[below], up_b[below])
                level[slot] = at
                values = np.zeros((2, len(nodes)), np.int64)
                for k, value in enumerate((leaves[whole], saved[whole])):
                    np.add.at(values[k], slot, value)
                order = np.argsort(-level, kind="stable")
                cuts = np.flatnonzero(np.diff(level[order])) + 1
                for group in np.split(order, cuts)[:-1]:  # deepest first; the last are roots
                    for value in values:
                        np.add.at(value, parent[group], value[group])
                yield _sums(nodes.a.view(np.int64), nodes.b.view(np.int64), *values)

    return run


def _sums(a: np.ndarray, b: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x) for x in (a, b, leaves, saved)], ["a", "b", "n_leaves", "saved"])


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of a node joined, a row per node and batch."""
    task, done = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, conv = (batch.column(c).to_numpy() for c in ("a", "b", "conv_id"))
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        ids = conv.tolist()
        texts = [",".join(map(str, ids[i:j])) for i, j in zip(first, [*first[1:], len(ids)], strict=True)]
        parts = task + done + np.arange(len(first))
        done += len(first)
        yield pa.record_batch([pa.array(a[first]), pa.array(b[first]), pa.array(parts), pa.array(texts, pa.string())], ["a", "b", "part", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node in order."""
    now, sha = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "ids")), strict=True):
            if (a, b) != now:
                if now is not None:
                    done.append((*now, sha.hexdigest()))
                now, sha = (a, b), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if done:
            yield _ends(done)
    if now is not None:
        yield _ends([(*now, sha.hexdigest())])


def _ends(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    a, b, sha = zip(*rows, strict=True)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha, pa.string())], ["a", "b", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """``a``, ``b``, ``ends_sha256`` of the conversations (``conv_id``) that end in each node. Ids are sorted over all tasks and joined in
    chunks; a digest needs its chunks in one place, in order, and reads them as a stream."""
    order = ["a", "b", "conv_id"]
    ranged = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = ranged.mapInArrow(_chunked, "a long, b long, part long, ids string")
    dealt = chunks.repartition("a", "b").sortWithinPartitions("a", "b", "part")
    return dealt.mapInArrow(_hashed, "a long, b long, ends_sha256 string")


def trie(numbered: DataFrame, members: DataFrame | None = None, shard: int = SHARD) -> DataFrame:
    """The nodes of conversations (``conv_id``, ``place`` from 1 without gaps, ``a``, ``b``, ``chars``; see :func:`numbered_turns`).

    ``members`` names all conversations, those without turns too; without it those with turns. A row per node: ``a``, ``b``
    (its digest), ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``
    (childless nodes in its subtree, itself included), ``saved`` (over its subtree, members but one times code
    points of the last text), ``ends_sha256`` (of the ids that end in it). The root has depth 0 and digest 0; without
    conversations there is no node.
    """
    members = numbered.select("conv_id").distinct() if members is None else members
    paths = paths_of(numbered, members)
    found = paths.mapInArrow(_enumerate(shard), "a long, b long, n long, conv_id long, depth long, up_a long, up_b long, chars long, total long")
    of_node = [F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), *(F.min(c).alias(c) for c in ("depth", "up_a", "up_b", "chars", "total"))]
    nodes = written(found.groupBy("a", "b").agg(*of_node), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    linked = (
        nodes.join(children, ["a", "b"], "left")
        .join(parents, ["up_a", "up_b"])
        .withColumns({"n_children": F.coalesce("n_children", F.lit(0).cast("long")), "parent_conv_id": F.when(F.col("depth") > 0, F.col("parent_conv_id"))})
    )
    linked = written(linked, "linked-nodes")
    last = paths.groupBy("conv_id").agg(F.max(F.struct("depth", "total", "a", "b")).alias("last"))
    last = written(last.select("conv_id", "last.total", "last.a", "last.b"), "ends")
    own = linked.groupBy("conv_id").agg(F.min(F.col("total") - F.col("chars")).alias("unowned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    known = written(
        last.join(own, "conv_id", "left").select("conv_id", F.coalesce("unowned", "total").alias("unowned"), F.coalesce("leaf", F.lit(0).cast("long")).alias("leaf")), "owners"
    )
    ordered = paths.join(known, "conv_id").sortWithinPartitions("conv_id", "depth")
    sums = ordered.mapInArrow(_accumulate(shard), "a long, b long, n_leaves long, saved long").groupBy("a", "b")
    summed = sums.agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    return (
        linked.join(summed, ["a", "b"])
        .join(end_digests(last), ["a", "b"], "left")
        .select(
            "a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved",
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations as they are: see :func:`numbered_turns` and :func:`trie`."""
    return trie(written(numbered_turns(turns), "numbered"))
