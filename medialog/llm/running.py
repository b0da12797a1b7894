"""Places and running sums within groups, for groups of any size.

Rows are dealt by ranges of (group, order), so that a group may lie in several tasks. Each task
numbers and sums its rows; only the first group of a task can go on from an earlier one, and what it
goes on from is a few numbers a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from medialog.llm.common import prepared, written


def _local(key: str, sums: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        first = last = None
        n, totals = 0, dict.fromkeys(sums, np.uint64(0))
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            group = batch.column(key).to_numpy()
            first = group[0] if first is None else first
            begins = np.concatenate([[True], group[1:] != group[:-1]])
            begins[0] = last is None or group[0] != last
            goes_on = not begins[0]
            starts = np.flatnonzero(begins)
            of = np.cumsum(begins) - 1  # -1: the group of the batch before
            nth = np.arange(rows) - np.concatenate([starts, [0]])[of] + 1
            nth[of < 0] += n
            out, n = [pa.array(nth, pa.int64())], int(nth[-1])
            for c in sums:
                run_ = np.concatenate([np.zeros(1, np.uint64), np.cumsum(batch.column(c).to_numpy().view(np.uint64), dtype=np.uint64)])
                base = np.concatenate([run_[starts], [np.uint64(0)]])[of]
                here = run_[1:] - base
                if goes_on:
                    here[of < 0] += totals[c]
                totals[c] = here[-1]
                out.append(pa.array(here.view(np.int64)))
            last = group[-1]
            out += [pa.array(np.full(rows, task), pa.int64()), pa.array(group == first)]
            yield pa.record_batch([*batch.columns, *out], [*batch.schema.names, "nth", *(f"run_{c}" for c in sums), "task", "head"])

    return run


def _carried(edges: list, sums: Sequence[str]) -> dict[int, tuple[int, ...]]:
    """By task, the place and the sums that its first group goes on from."""
    out, before = {}, None
    for task, first, end in sorted((e["task"], e["first"], e["end"]) for e in edges):
        here = (end["nth"], *(end[f"run_{c}"] for c in sums))
        if before is not None and before[0] == first:
            out[task] = before[1]
            if end["key"] == first:
                here = tuple(x + y for x, y in zip(here, before[1], strict=True))
        before = (end["key"], here)
    return out


def running(df: DataFrame, key: str, order: Sequence[Column | str], sums: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """``df`` with ``nth``, a row's place in its group from 1, and ``run_<c>`` for every column in ``sums``:
    its sum up to this row, modulo 2^64.

    ``key`` and ``sums`` are longs without nulls. ``order`` follows the key, which comes first of itself, and should tell
    rows apart: rows alike in it stay in one task. The result lies in the shared folder.
    """
    spark = prepared(df.sparkSession)
    parts = [partitions] if partitions else []
    ranged = df.repartitionByRange(*parts, key, *order).sortWithinPartitions(key, *order)
    names = ["nth", *(f"run_{c}" for c in sums)]
    schema = StructType(list(df.schema.fields))
    for c in names:
        schema = schema.add(c, LongType(), False)
    wide = StructType(list(schema.fields)).add("task", LongType(), False).add("head", BooleanType(), False)
    found = written(ranged.mapInArrow(_local(key, sums), wide), "running")
    end = F.max(F.struct(F.col(key).alias("key"), *names))
    carried = _carried(found.groupBy("task").agg(F.min(key).alias("first"), end.alias("end")).collect(), sums)
    if not carried:
        return found.select(*[F.col(f"`{c}`") for c in schema.names])
    # A few numbers a task.
    table = np.zeros((len(names), max(carried) + 1), np.uint64)
    for task, values in carried.items():
        table[:, task] = [v % (1 << 64) for v in values]
    shared, own = spark.sparkContext.broadcast(table), df.columns

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = shared.value
        for batch in batches:
            task = np.minimum(batch.column("task").to_numpy(), more.shape[1])
            head = batch.column("head").to_numpy(zero_copy_only=False)
            columns = [batch.column(c) for c in own]
            for k, c in enumerate(names):
                add = np.where(head, np.append(more[k], np.uint64(0))[task], np.uint64(0))
                columns.append(pa.array((batch.column(c).to_numpy().view(np.uint64) + add).view(np.int64)))
            yield pa.record_batch(columns, schema.names)

    return found.mapInArrow(carry, schema)
