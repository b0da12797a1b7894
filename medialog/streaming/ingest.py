"""Continuous ingestion of raw responses into the access log. No row is dropped for being late.

That a response is new is found in two ways. Responses that arrived within a horizon are in keyed state, which holds an id from its
arrival on. A response cannot arrive before it was sent: one sent within the horizon, if it came before, is in the state.
Only older ones are compared with the log, in the days they belong to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from medialog.schemas import RAW_REQUESTS
from medialog.sources.requests import enrich_requests
from medialog.sources.store import BATCH, DAY, append_log, read_log
from medialog.streaming.state import keyed_state

HORIZON = "2 days"
ARRIVED = "arrived_at"


def raw_stream(spark: SparkSession, path: str, kind: str = "json", files_per_batch: int | None = None) -> DataFrame:
    """Raw responses as the web tier drops them, a file at a time."""
    reader = spark.readStream.schema(RAW_REQUESTS).format(kind)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def once(rows: DataFrame, id_col: str, horizon: str = HORIZON) -> DataFrame:
    """Rows of a stream, each id once in a horizon of arrival, with the time of arrival.

    Arrival is the time of the batch: it never runs backwards, so no row is late by it and none is dropped for that. Rows
    without an id cannot be told apart and all stay.
    """
    keyed_state(rows.sparkSession)
    key = F.coalesce(F.col(id_col).cast("string"), F.expr("uuid()"))
    arrived = rows.withColumns({ARRIVED: F.current_timestamp(), "response_key": key})
    return arrived.withWatermark(ARRIVED, horizon).dropDuplicatesWithinWatermark(["response_key"]).drop("response_key")


def in_state(at: Column, horizon: str = HORIZON) -> Column:
    """Whether a row of this time would be in the state if it had come before."""
    return F.coalesce(at >= F.col(ARRIVED) - F.expr(f"INTERVAL {horizon}"), F.lit(False))


def not_stored(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Rows whose id the log does not hold on the same day; only the days at hand are read."""
    dated = rows.withColumn(DAY, F.to_date("requested_at"))
    days = dated.select(DAY).distinct()
    stored = log.select("id", DAY).join(days, DAY, "left_semi")
    return dated.join(stored, ["id", DAY], "left_anti").drop(DAY)


def ingest(raw: DataFrame, path: str, checkpoint: str, name: str = "stream", horizon: str = HORIZON) -> StreamingQuery:
    """Append what has arrived to the log at ``path`` and stop.

    A response may be reported any number of times and as late as it likes; the log holds it
    once. Responses without an id are all appended. The first batch of a checkpoint compares all its rows with the log, as its state is
    empty. A batch that is run again leaves itself out of the comparison and replaces its own
    folders. Several streams into one log need a ``name`` each, and should not report the same
    responses.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        label = f"{name}-{epoch}"
        # Persisted, so that the state is not gone through once per use.
        batch = enrich_requests(batch, keep=(ARRIVED,)).persist()
        try:
            known = in_state(F.col("requested_at"), horizon) if epoch else F.lit(False)
            fresh, old = batch.where(known).drop(ARRIVED), batch.where(~known).drop(ARRIVED)
            if not old.isEmpty():
                others = read_log(batch.sparkSession, path).where(F.col(BATCH) != label)
                old = not_stored(old, others)
            append_log(fresh.unionByName(old), path, label)
        finally:
            batch.unpersist()

    return (
        once(raw, "request_id", horizon)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
