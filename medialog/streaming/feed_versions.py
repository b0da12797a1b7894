"""Feed version state, moved forward batch by batch: one value a show, in keyed state.

A batch touches the state of the shows it has observations of. What it changed is written as a
folder of its own, so it costs what it changed, however many shows there are. Readers take the last row of
each show; :func:`settle` puts the folders together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from medialog.sources.files import remove_folder, subfolders
from medialog.streaming.state import keyed_state

STATE = "show_id STRING, version STRING, modified_at TIMESTAMP"
OBSERVED = "show_id STRING, version STRING, last_build_at TIMESTAMP, observed_at TIMESTAMP"
_STORED = f"{STATE}, epoch BIGINT"
_MICROS = "show_id STRING, version STRING, built BIGINT, observed BIGINT"


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last observation of each show in a batch of a task, so that a busy show sends few rows on."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).sort_by([("observed", "descending"), ("version", "descending")])
        shows = table.column("show_id").to_pylist()
        met: set = set()
        keep = [not (s in met or met.add(s)) for s in shows]
        yield from table.filter(pa.array(keep, pa.bool_())).to_batches()


class Versions(StatefulProcessor):
    """A show's version and the time it was modified, which only moves forward.

    The same version keeps its time; a new one takes its build date, or the time of observation if that date did not advance.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("version", "version STRING, modified BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = None
        for frame in rows:
            for seen in frame[["observed", "version", "built"]].itertuples(index=False, name=None):
                if last is None or seen[:2] > last[:2]:
                    last = seen
        if last is None:
            return
        observed, version, built = last
        old = self.state.get() if self.state.exists() else None
        if old is not None and old[0] == version:
            return
        at = observed if old is not None and built <= old[1] else built
        at -= at % 1_000_000
        self.state.update((version, int(at)))
        yield pd.DataFrame({"show_id": [key[0]], "version": [version], "modified": [int(at)]})

    def close(self) -> None:
        pass


def advanced(observed: DataFrame) -> DataFrame:
    """Shows whose version changed, with the new one and its time."""
    keyed_state(observed.sparkSession)
    micros = observed.where("show_id IS NOT NULL AND version IS NOT NULL").select(
        "show_id", "version", F.coalesce(F.unix_micros("last_build_at"), F.unix_micros("observed_at")).alias("built"), F.unix_micros("observed_at").alias("observed")
    )
    changed = micros.mapInArrow(_last, _MICROS).groupBy("show_id").transformWithStateInPandas(
        Versions(), "show_id STRING, version STRING, modified BIGINT", outputMode="Update", timeMode="None"
    )
    return changed.select("show_id", "version", F.timestamp_micros("modified").alias("modified_at"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """Current version of every show: its last change."""
    rows = spark.read.schema(_STORED).option("recursiveFileLookup", "true").parquet(path)
    last = F.max_by(F.struct("version", "modified_at"), "epoch").alias("last")
    return rows.groupBy("show_id").agg(last).select("show_id", "last.*")


def follow_versions(observed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Advance the versions with every batch of observed documents.

    A busy show may have many observations in a batch; only its last one counts, found in each task first. The
    observation time stands for now. Rows without show or version are passed over. A replayed batch
    overwrites its own folder.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        rows = batch.withColumn("epoch", F.lit(epoch).cast("bigint"))
        rows.write.mode("overwrite").parquet(f"{path}/changes-{epoch}")

    spark = observed.sparkSession
    spark.createDataFrame([], _STORED).write.mode("ignore").parquet(f"{path}/none")
    return (
        advanced(observed)
        .writeStream.foreachBatch(store)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def settle(spark: SparkSession, path: str) -> None:
    """Put the changes so far into one folder, between two runs of the job. A crash leaves rows twice at most,
    which readers do not notice."""
    folders = [f for f in subfolders(path) if f.startswith(("changes-", "settled-"))]
    if len(folders) < 2:
        return
    rows = spark.read.schema(_STORED).parquet(*[f"{path}/{f}" for f in folders])
    columns = [f"last.{c}" for c in ("version", "modified_at", "epoch")]
    last = rows.groupBy("show_id").agg(F.max_by(F.struct("version", "modified_at", "epoch"), "epoch").alias("last")).select("show_id", *columns)
    newest = max(int(f.split("-")[1]) for f in folders)
    number = 1 + max((int(f.split("-")[2]) for f in folders if f.startswith("settled-")), default=0)
    last.write.parquet(f"{path}/settled-{newest}-{number}")
    for folder in folders:
        remove_folder(f"{path}/{folder}")
    spark.catalog.refreshByPath(path)
