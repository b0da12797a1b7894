"""Running daily figures of every show.

The job follows the log. Counters per show and quarter hour are kept in state while the quarter hour is recent, and each batch writes
those that it changed. A row of an older quarter hour has no state to be added to and leaves none: its quarter hour is counted anew from
the log, which holds the row, and replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from medialog.functions.moments import local_date
from medialog.operators.access_log import is_media, succeeded
from medialog.operators.rollups import COUNTERS, media_measures, named
from medialog.schemas import MEDIA_ACCESS
from medialog.sources.store import BATCH, DAY
from medialog.streaming.ingest import ARRIVED, HORIZON, once
from medialog.streaming.state import keyed_state

# Quarter hours tile local days in every zone in use today.
STEP = "15 minutes"
_STEP_MICROS = 15 * 60 * 1_000_000
_TOTALS = "step_start TIMESTAMP, show_id STRING, downloads BIGINT, streams BIGINT, failures BIGINT, bytes BIGINT, epoch BIGINT"
_COUNTED = "show_id STRING, step BIGINT, arrived BIGINT, downloads BIGINT, streams BIGINT, failures BIGINT, bytes BIGINT"
_UNITS = {"day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1_000}


def milliseconds(text: str) -> int:
    """Of an interval like '2 days'."""
    number, unit = re.fullmatch(r"(\d+) (\w+?)s?", text).groups()
    return int(number) * _UNITS[unit]


def step_totals(log: DataFrame) -> DataFrame:
    """Counters per show and quarter hour."""
    return (
        log.where(is_media())
        .groupBy(F.window("requested_at", STEP), "show_id")
        .agg(*named(media_measures()))
        .select(F.col("window.start").alias("step_start"), "show_id", *COUNTERS)
    )


def log_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Rows as they come into a stored log. Files that a repeated batch has replaced meanwhile are passed over."""
    reader = spark.readStream.schema(f"{MEDIA_ACCESS}, {DAY} DATE, {BATCH} STRING").option("ignoreMissingFiles", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _step(at: Column) -> Column:
    return F.floor(F.unix_micros(at) / _STEP_MICROS)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters added up in the task, so that a busy show sends few rows on."""
    for batch in batches:
        keys = ["show_id", "step", "arrived"]
        sums = pa.Table.from_batches([batch]).group_by(keys).aggregate([(c, "sum") for c in COUNTERS])
        yield from sums.select([*keys, *(f"{c}_sum" for c in COUNTERS)]).rename_columns([*keys, *COUNTERS]).to_batches()


class Steps(StatefulProcessor):
    """Counters of one show and quarter hour while it is recent.

    The clock is the time of the batch that rows arrive in. The event-time watermark follows it, a horizon behind, and ends the state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("counters", ", ".join(f"{c} BIGINT" for c in (*COUNTERS, "ends")))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sums, now = [0] * len(COUNTERS), 0
        for frame in rows:
            sums = [s + int(frame[c].sum()) for s, c in zip(sums, COUNTERS, strict=True)]
            now = max(now, int(frame["arrived"].max()))
        show, step = key
        if self.state.exists():
            *before, ends = self.state.get()
            sums = [s + old for s, old in zip(sums, before, strict=True)]
            self.handle.deleteTimer(ends)
        # The watermark is here a horizon from now, when the quarter hour is no longer recent.
        ends = now + _STEP_MICROS // 1_000
        self.handle.registerTimer(ends)
        self.state.update((*sums, ends))
        yield pd.DataFrame({"show_id": [show], "step": [step], **{c: [s] for c, s in zip(COUNTERS, sums, strict=True)}, "anew": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def running_totals(log: DataFrame, horizon: str = HORIZON) -> DataFrame:
    """Of a stream of log rows the counters of what each batch changed; ``anew``, any number of times, where they are not whole."""
    keyed_state(log.sparkSession)
    ok = F.coalesce(succeeded(), F.lit(False))
    parts = {
        "downloads": ok & (F.col("kind") == "download"),
        "streams": ok & (F.col("kind") == "stream"),
        "failures": ~F.coalesce(succeeded(), F.lit(True)),
    }
    step, media = _step(F.col("requested_at")), log.where(is_media() & F.col("requested_at").isNotNull())
    # The time of the batch, as in the column of arrival.
    recent = step * (_STEP_MICROS // 1_000) >= F.unix_millis(F.current_timestamp()) - milliseconds(horizon)
    rows = once(media.where(recent), "id", horizon).select(
        "show_id", step.alias("step"), F.unix_millis(ARRIVED).alias("arrived"), *[c.cast("bigint").alias(n) for n, c in parts.items()], F.coalesce("bytes_sent", F.lit(0)).cast("bigint").alias("bytes")
    )
    counted = rows.mapInArrow(_combined, _COUNTED).groupBy("show_id", "step").transformWithStateInPandas(
        Steps(), f"show_id STRING, step BIGINT, {', '.join(f'{c} BIGINT' for c in COUNTERS)}, anew BOOLEAN", outputMode="Append", timeMode="EventTime"
    )
    # Older quarter hours are counted from the log, so that it does not matter how often a row of theirs comes.
    older = media.where(~recent).select("show_id", step.alias("step"), *[F.lit(0).cast("bigint").alias(c) for c in COUNTERS], F.lit(True).alias("anew"))
    return counted.unionByName(older)


def follow(log: DataFrame, stored: Callable[[], DataFrame], path: str, checkpoint: str, horizon: str = HORIZON) -> StreamingQuery:
    """Keep the totals at ``path`` up to date with a stream of log rows; ``stored`` gives the log itself.

    A row counts once, however often its file is written again. What is older than the horizon when it arrives is counted
    from the log, in the days it belongs to; so is everything when the job first meets a log.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.distinct().persist()  # a row for each older row becomes one for each older quarter hour
        try:
            start = F.timestamp_micros(F.col("step") * _STEP_MICROS)
            whole = batch.where("NOT anew").select(start.alias("step_start"), "show_id", *COUNTERS)
            missing = batch.where("anew").select(F.col("show_id").alias("of_show"), F.col("step").alias("of_step"))
            if not missing.isEmpty():
                rows = stored().where(is_media())
                if DAY in rows.columns:
                    days = missing.select(F.to_date(F.timestamp_micros(F.col("of_step") * _STEP_MICROS)).alias(DAY)).distinct()
                    rows = rows.join(days, DAY, "left_semi")
                same = rows["show_id"].eqNullSafe(F.col("of_show")) & (_step(rows["requested_at"]) == F.col("of_step"))
                whole = whole.unionByName(step_totals(rows.join(missing, same, "left_semi")))
            whole.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{path}/changes-{epoch}")
        finally:
            batch.unpersist()

    log.sparkSession.createDataFrame([], _TOTALS).write.mode("ignore").parquet(f"{path}/none")
    return (
        running_totals(log, horizon)
        .writeStream.foreachBatch(write)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """Counters per show and quarter hour: the last that were written."""
    rows = spark.read.schema(_TOTALS).option("recursiveFileLookup", "true").parquet(path)
    last = F.max_by(F.struct(*COUNTERS), "epoch").alias("last")
    return rows.groupBy("show_id", "step_start").agg(last).select("show_id", "step_start", "last.*")


def daily_by_show(totals: DataFrame, zone: str) -> DataFrame:
    """Local-day counters from the written steps."""
    day = local_date(F.col("step_start"), zone).alias("local_date")
    return totals.groupBy(day, "show_id").agg(*[F.sum(c).alias(c) for c in COUNTERS])
