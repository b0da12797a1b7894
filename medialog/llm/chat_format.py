r"""Conversations as training text, assembled column by column.

A turn is written ``### Role: text</turn>`` and a line end. Inside texts and roles a backslash is
doubled, ``##`` becomes ``\#\#`` and ``</turn>`` becomes ``<\/turn>``, and inside roles a colon before a
space is parted from it. Of a run of signs at most the last one stays as it is, so no control string is ever found in them;
taking every backslash away from the character after it gives the text back.

Turns are dealt by ranges of (conversation, turn), so that a very long conversation is spread over
tasks. A task turns each batch of rows into segments (a header for the role, the content, an
end), works out their lengths, offsets and scatter indices with numpy and copies all bytes into one
preallocated Arrow buffer. A conversation comes in one part or, where a task or a batch ends
inside it, in several, numbered in order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialog.llm.common import prepared, slices, written

HEAD, SEP, END = b"### ", b": ", b"</turn>\n"
LEARNED = "assistant"
# Bytes of texts in one batch, and of scatter indices worked out at once.
BATCH = 4 << 20
SPAN = 1 << 20


def escaped(texts: pa.Array) -> pa.Array:
    """Control strings of a column of texts escaped; null as empty."""
    out = pa.compute.fill_null(texts, "")
    for plain, safe in (("\\", "\\\\"), ("##", "\\#\\#"), ("</turn>", "<\\/turn>")):
        out = pa.compute.replace_substring(out, plain, safe)
    return out


def _escaped_roles(roles: pa.Array) -> pa.Array:
    return pa.compute.replace_substring(escaped(roles), ": ", ":\\ ")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its values."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Copy ``data[starts[k] : starts[k] + lengths[k]]`` to ``out[at[k]:]`` for all k."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    for first in range(0, int(total[-1]), SPAN):
        place = np.arange(first, min(first + SPAN, int(total[-1])))
        k = np.searchsorted(total, place, side="right") - 1
        within = place - total[k]
        out[at[k] + within] = data[starts[k] + within]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of formatted turns in order; where each turn begins, and its content begins and ends."""
    kinds = roles.dictionary_encode()
    heads, head_offsets = _bytes_of(pa.compute.binary_join_element_wise(HEAD.decode(), _escaped_roles(kinds.dictionary), SEP.decode(), ""))
    kind = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    body, body_offsets = _bytes_of(escaped(texts))
    head_size, body_size = np.diff(head_offsets)[kind], np.diff(body_offsets)
    ends = np.cumsum(head_size + body_size + len(END))
    begins = ends - head_size - body_size - len(END)
    content = begins + head_size
    buffer = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    _scatter(buffer, begins, heads, head_offsets[:-1][kind], head_size)
    _scatter(buffer, content, body, body_offsets[:-1], body_size)
    _scatter(buffer, content + body_size, np.frombuffer(END, np.uint8), np.zeros(len(ends), np.int64), np.full(len(ends), len(END)))
    return buffer, begins, content, content + body_size


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, count = TaskContext.get().partitionId(), 0
    for batch in slices(batches, "text", BATCH):
        roles = pa.compute.fill_null(batch.column("role"), "")
        buffer, begins, start, end = assemble(roles, batch.column("text"))
        ids = batch.column("conv_id")
        codes = pa.compute.fill_null(ids.dictionary_encode(null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        last = np.concatenate([first[1:], [len(codes)]])
        offsets = np.concatenate([begins[first], [len(buffer)]]).astype(np.int32)
        texts = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(buffer))
        learned = pa.compute.equal(roles, LEARNED).to_numpy(zero_copy_only=False)
        spans = [
            [{"start": int(a - begins[f]), "end": int(b - begins[f])} for a, b in zip(start[f:n][learned[f:n]], end[f:n][learned[f:n]], strict=True)]
            for f, n in zip(first, last, strict=True)
        ]
        parts = [(task << 32) + count + k for k in range(len(first))]
        count += len(first)
        yield pa.record_batch(
            [ids.take(pa.array(first)), pa.array(parts, pa.int64()), pa.array(last - first, pa.int64()), texts, pa.array(spans, _SPANS)],
            ["conv_id", "part", "n_turns", "text", "loss"],
        )


def format_conversations(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """``conv_id``, ``part``, ``n_turns``, ``text``, ``loss`` of turns (``conv_id``, ``turn``, ``role``, ``text``).

    The parts of a conversation in order are its text. ``loss`` has the byte ranges of the text
    that are to be learned: the contents of assistant turns. Rows of equal turn follow by role,
    then by a hash of their text. A null turn comes first; null texts and roles are empty; rows of no
    conversation are one conversation. Repeated rows are turns of their own. An empty table gives
    no rows.
    """
    spark = prepared(turns.sparkSession)
    rows = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    ranged = rows.repartitionByRange(partitions or spark.sparkContext.defaultParallelism * 4, *order).sortWithinPartitions(*order)
    kind = rows.schema["conv_id"].dataType.simpleString()
    return ranged.select("conv_id", "role", "text").mapInArrow(
        _format, f"conv_id {kind}, part long, n_turns long, text string, loss array<struct<start: int, end: int>>"
    )


@dataclass
class Reader:
    """Reads the parts of one conversation in order and sums it up."""

    n_turns: int = 0
    formatted: int = 0
    loss_chars: int = 0
    turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, text: str, loss: list[dict]) -> None:
        self.formatted += len(text)
        for role, content in read_turns(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{content}\n".encode())
        data = text.encode()
        for span in loss:
            content = unescaped(data[span["start"] : span["end"]].decode())
            self.loss_chars += len(content)
            self.loss.update(content.encode())

    def row(self) -> tuple[int, str, int, str, int]:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted text."""
    at, end = 0, END.decode()
    while at < len(text):
        role_end = text.index(SEP.decode(), at)
        stop = text.index(end, role_end)
        yield unescaped(text[at + len(HEAD) : role_end]), unescaped(text[role_end + len(SEP) : stop])
        at = stop + len(end)


_SUMS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
_SUM_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _sum_up(edges: bool):
    """Sums of conversations whose parts come in order. With ``edges`` the first and last of a task,
    which may go on elsewhere, are passed on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        now, reader, at_edge = none, Reader(), edges
        held: list[tuple] = []  # parts of the conversation that may be the task's last

        def out(kind: pa.DataType, done: list[tuple], parts: list[tuple]) -> pa.RecordBatch:
            rows = [(c, None, *sums, None, None) for c, sums in done] + [(c, p, *[None] * 5, t, loss) for c, p, t, loss in parts]
            names = ["conv_id", "part", *_SUMS, "text", "loss"]
            types = [kind, pa.int64(), *_SUM_TYPES, pa.string(), _SPANS]
            return pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("conv_id").type
            done, parts = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "text", "loss")), strict=True):
                if now is none or row[0] != now:
                    if now is not none:
                        if not at_edge:
                            done.append((now, reader.row()))
                        at_edge = False
                    now, reader, held = row[0], Reader(), []
                if at_edge:
                    parts.append(row)
                else:
                    reader.add(row[2], row[3])
                    if edges:
                        held.append(row)
                        # Too long to be held: pass it on and go on passing it on.
                        if sum(len(h[2]) for h in held) > 4 * BATCH:
                            parts += held
                            held, at_edge = [], True
            if done or parts:
                yield out(kind, done, parts)
        if now is not none and not at_edge:
            yield out(kind, [], held) if edges else out(kind, [(now, reader.row())], [])

    return run


def sum_up(formatted: DataFrame) -> DataFrame:
    """A row per conversation, read back from :func:`format_conversations`: ``conv_id``, ``n_turns``,
    ``turns_sha256``, ``loss_chars``, ``loss_sha256``, ``formatted_chars``.

    A digest needs a conversation's parts in order. Those that lie within one task are read where
    they were made; only the first and last of each task move.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    sums = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = f"conv_id {kind}, part long, {sums}, text string, loss array<struct<start: int, end: int>>"
    found = written(formatted.select("conv_id", "part", "text", "loss").mapInArrow(_sum_up(True), schema), "chat-sums")
    split = found.where("part IS NOT NULL").select("conv_id", "part", "text", "loss")
    joined = split.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_sum_up(False), schema)
    return found.where("part IS NULL").union(joined).select("conv_id", *_SUMS)
