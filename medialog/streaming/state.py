"""What the jobs with keyed state share."""

from __future__ import annotations

from pyspark.sql import SparkSession

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """Keep state in RocksDB, on disk: only keys in a batch are read. A running checkpoint keeps what it began with.

    A commit writes what changed, and a key is not read again to count the keys when it is written.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
