"""A copy of the log and the episodes in buckets of the episode, for joins and totals that do not move the log.

Both tables are written in the same number of buckets by one key, so matching rows lie in matching buckets. The key is the
episode; an episode with far more rows than a bucket should have is dealt over several keys, and its
catalogue row is there once for each; rows without an episode are dealt over all buckets. The layout is by Spark's
own bucketed tables at a path.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialog.operators.access_log import is_media, succeeded, within
from medialog.operators.joins import lookup_join
from medialog.operators.rollups import media_measures, named

KEY = "bucket_key"
BUCKETS = 64


def _dealt(counts: DataFrame, buckets: int) -> DataFrame:
    """Episodes with more than twice a bucket's share of the rows, and over how many keys each is dealt.

    They are fewer than half the buckets, whatever the number of episodes.
    """
    share = counts.agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / buckets)).alias("share")).scalar()
    hot = counts.where(F.col("episode_id").isNotNull() & (F.col("n") > 2 * share))
    return hot.select(F.col("episode_id").alias("hot_id"), F.ceil(F.col("n") / share).cast("int").alias("keys"))


@dataclass
class Buckets:
    """The two tables, named in the session's catalogue."""

    spark: SparkSession
    name: str

    @property
    def log(self) -> DataFrame:
        return self.spark.table(f"{self.name}_log")

    @property
    def episodes(self) -> DataFrame:
        return self.spark.table(f"{self.name}_episodes")


def write_buckets(log: DataFrame, episodes: DataFrame, path: str, buckets: int = BUCKETS) -> Buckets:
    """Write both tables to a new folder."""
    spark = log.sparkSession
    made = Buckets(spark, f"buckets_{uuid.uuid4().hex}")
    hot = _dealt(log.groupBy("episode_id").agg(F.count("*").alias("n")), buckets)
    hot = spark.createDataFrame(hot.collect(), hot.schema)  # fewer rows than buckets
    spread = F.pmod(F.xxhash64("id"), F.coalesce("keys", F.lit(buckets)))
    own = F.when(F.col("keys").isNotNull() | F.col("episode_id").isNull(), F.concat(F.coalesce("episode_id", F.lit("")), F.lit("#"), spread.cast("string")))
    keyed = log.join(F.broadcast(hot), F.col("episode_id") == F.col("hot_id"), "left").withColumn(KEY, F.coalesce(own, "episode_id"))
    copies = episodes.join(F.broadcast(hot), F.col("id") == F.col("hot_id"), "left").withColumn(
        KEY, F.explode(F.when(F.col("keys").isNull(), F.array("id")).otherwise(F.transform(F.sequence(F.lit(0), F.col("keys") - 1), lambda k: F.concat("id", F.lit("#"), k.cast("string")))))
    )
    for rows, table in ((keyed, "log"), (copies, "episodes")):
        # Dealt as buckets are, so that each is one file.
        dealt = rows.drop("hot_id", "keys").repartition(buckets, KEY)
        dealt.write.bucketBy(buckets, KEY).sortBy(KEY).option("path", f"{path}/{table}").saveAsTable(f"{made.name}_{table}")
    return made


def enrich_log(tables: Buckets, shows: DataFrame) -> DataFrame:
    """As :func:`access_log.enrich_log`: titles beside every log row. Buckets are joined where they lie."""
    titles = tables.episodes.select(KEY, F.col("title").alias("episode_title"), F.col("filename").alias("episode_filename"))
    names = shows.select(F.col("id").alias("show_id"), F.col("title").alias("show_title"), F.col("slug").alias("show_slug"))
    return lookup_join(tables.log.join(titles, KEY, "left").drop(KEY), names, ["show_id"], ["id"])


def busiest(tables: Buckets, shows: DataFrame, k: int = 10, frm=None, to=None) -> DataFrame:
    """As :func:`rollups.busiest`: the log is counted in its buckets, and what moves is a row per episode."""
    rows = within(tables.log, frm, to).where(is_media() & succeeded() & F.col("show_id").isNotNull())
    measures = media_measures()
    del measures["failures"]
    parts = rows.groupBy(KEY, "episode_id").agg(F.max("show_id").alias("show_id"), *named(measures), F.max("requested_at").alias("last_at"))
    titled = parts.join(tables.episodes.select(KEY, "title"), KEY)
    whole = titled.groupBy("episode_id").agg(
        F.max("show_id").alias("show_id"), F.max("title").alias("title"), *[F.sum(c).alias(c) for c in measures], F.max("last_at").alias("last_at")
    )
    names = shows.select(F.col("id").alias("show_id"), F.col("title").alias("show_title"), F.col("slug").alias("show_slug"))
    joined = lookup_join(whole, names, ["show_id"], ["episode_id"], "inner").drop("show_id")
    return joined.orderBy(F.desc("downloads"), F.desc("streams"), F.desc("bytes"), F.asc("episode_id")).limit(max(1, k))
