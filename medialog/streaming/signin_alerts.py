"""Alerts on repeated sign-in failures: by window ends, or exactly, at every attempt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from medialog.operators.signin import BACKOFF_STEPS, WINDOW_MINUTES
from medialog.streaming.state import keyed_state

LATENESS = "10 minutes"
# The first number of failures that makes a user wait.
THRESHOLD = next(i for i, seconds in enumerate(BACKOFF_STEPS) if seconds > 0)


def alert_windows(attempts: DataFrame, slide: str = "1 minute", lateness: str = LATENESS) -> DataFrame:
    """Users with enough failures in a trailing window, for every window end."""
    window = F.window("attempted_at", f"{WINDOW_MINUTES} minutes", slide)
    return (
        attempts.withWatermark("attempted_at", lateness)
        .where("succeeded = 0")
        .groupBy(window, "username")
        .agg(F.count("*").alias("failures"))
        .where(F.col("failures") >= THRESHOLD)
        .select("username", F.col("window.end").alias("window_end"), "failures")
    )


def watch(attempts: DataFrame, path: str, checkpoint: str, slide: str = "1 minute") -> StreamingQuery:
    """Append the alerts of closed windows."""
    return (
        alert_windows(attempts, slide)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


_MINUTE = 60_000_000
# The state of a user is kept by blocks of this length, or of the window's, if that is longer.
BLOCK_MINUTES = 60
_ROW = np.dtype([("at", "i8"), ("id", "i8"), ("succeeded", "i8"), ("done", "i8")])
_COUNTS = "username STRING, id BIGINT, at BIGINT, succeeded INT, trailing_failures BIGINT, failures BIGINT"


class Trailing(StatefulProcessor):
    """A block of a user's attempts that the watermark has not passed, and the attempts of the window before it.

    Attempts wait for the watermark, so that they are counted in the order of their times, at the minute after them. A block
    has one timer, on the minute of its first waiting attempt, which counts all that the watermark has passed; so a batch goes
    through a block once. Attempts that have left the window are forgotten, and the block when it has ended.
    """

    def __init__(self, minutes: int, block: int):
        self.length, self.block = minutes * _MINUTE, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Rows of a batch in one value, as bytes.
        self.held = handle.getListState("held", "rows BINARY")
        self.timer = handle.getValueState("timer", "at BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = []
        for frame in rows:
            new = np.empty(len(frame), _ROW)
            for column in _ROW.names:
                new[column] = frame[column].to_numpy()
            parts.append(new)
        new = np.concatenate(parts)
        self.held.appendValue((new.tobytes(),))
        self._wake(key, new)
        yield from ()

    def _wake(self, key, rows: np.ndarray) -> None:
        """Set the timer to the minute of the first waiting row, else to the end of the block."""
        waiting = rows["at"][rows["done"] == 0]
        at = int(waiting.min()) if len(waiting) else (int(key[1]) + 1) * self.block
        at = -(-at // _MINUTE) * (_MINUTE // 1_000)
        if self.timer.exists():
            before = self.timer.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = timerValues.getCurrentWatermarkInMs() * 1_000 // _MINUTE * _MINUTE
        rows = np.concatenate([np.frombuffer(bytes(chunk), _ROW) for (chunk,) in self.held.get()])
        rows = rows[np.lexsort((rows["id"], rows["at"]))]
        at, place = rows["at"], np.arange(len(rows))
        due = np.flatnonzero((at <= limit) & (rows["done"] == 0))
        failed = np.concatenate(([0], np.cumsum(rows["succeeded"] == 0)))
        first = np.searchsorted(at, at - self.length, "left")
        trailing = failed[np.searchsorted(at, at, "right")] - failed[first]
        reset = np.maximum.accumulate(np.where(rows["succeeded"] == 1, place, -1))
        failures = failed[place + 1] - failed[np.maximum(first, reset + 1)]
        left = rows[at > limit - self.length]
        left["done"] |= left["at"] <= limit
        self.held.clear()
        self.timer.clear()
        if limit < (int(key[1]) + 1) * self.block:
            if len(left):
                self.held.appendValue((left.tobytes(),))
            self._wake(key, left)
        if len(due):
            yield pd.DataFrame(
                {
                    "username": key[0], "id": rows["id"][due], "at": at[due], "succeeded": rows["succeeded"][due].astype("i4"),
                    "trailing_failures": trailing[due], "failures": failures[due],
                }
            )

    def close(self) -> None:
        pass


def trailing(attempts: DataFrame, minutes: int = WINDOW_MINUTES, lateness: str = LATENESS) -> DataFrame:
    """Of a stream of attempts, each one that the watermark has passed, with ``trailing_failures``, the user's failures in the
    minutes up to it, as in :func:`operators.signin.trailing_failures`, and ``failures``, those since the last success.

    State is kept by user and block of time, so that a user with very many attempts is spread; an attempt that the window
    of the next block reaches goes there too, where it is only counted. Attempts without a user or a time are left out.
    """
    keyed_state(attempts.sparkSession)
    block = max(minutes, BLOCK_MINUTES) * _MINUTE
    at = F.unix_micros("attempted_at")
    own = F.floor(at / block)
    reaches = at >= (own + 1) * block - minutes * _MINUTE
    rows = (
        attempts.withWatermark("attempted_at", lateness)
        .where("username IS NOT NULL AND attempted_at IS NOT NULL")
        .select(
            "username", "attempted_at", "id", at.alias("at"), F.coalesce("succeeded", F.lit(-1)).alias("succeeded"), own.alias("own"),
            F.explode(F.when(reaches, F.array(own, own + 1)).otherwise(F.array(own))).alias("block"),
        )
        .withColumn("done", (F.col("own") != F.col("block")).cast("int"))
        .drop("own")
    )
    found = rows.groupBy("username", "block").transformWithStateInPandas(Trailing(minutes, block), _COUNTS, outputMode="Append", timeMode="EventTime")
    return found.select(
        "username", "id", F.timestamp_micros("at").alias("attempted_at"), F.nullif("succeeded", F.lit(-1)).alias("succeeded"), "trailing_failures", "failures"
    )


def watch_attempts(attempts: DataFrame, path: str, checkpoint: str, threshold: int = THRESHOLD, lateness: str = LATENESS) -> StreamingQuery:
    """Append every attempt that has at least ``threshold`` failures in the window up to it."""
    return (
        trailing(attempts, lateness=lateness)
        .where(F.col("trailing_failures") >= threshold)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


ALERT_SCHEMA = "username STRING, id BIGINT, attempted_at TIMESTAMP, succeeded INT, trailing_failures BIGINT, failures BIGINT"
