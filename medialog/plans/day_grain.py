"""The access log reduced to days, so that the figures of a period do not read the log again.

Three tables, a folder per local day in each:

* ``episode``: counters per day, show and episode.
* ``show``: counters per day and show.
* ``touched``: per day and show, which episodes had media requests, as bitmaps over densely numbered
  episodes. Counts of distinct episodes do not add up over days; their bitmaps do, by OR.

A late row changes its day alone: :meth:`DayGrain.refresh` reads the log of the days it is given and replaces their
folders. It can be run again after a crash. One refresh runs at a time.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medialog.functions.calendar import bucket_days
from medialog.functions.moments import local_date
from medialog.functions.numbers import change_between
from medialog.operators.access_log import is_media, succeeded
from medialog.operators.rollups import COUNTERS, SHOW_COUNTERS, media_measures, named, zero_fill
from medialog.sources.files import remove_folder
from medialog.sources.store import DAY

_MEASURES = "downloads BIGINT, streams BIGINT, failures BIGINT, bytes BIGINT, feed_fetches BIGINT, last_at TIMESTAMP, feed_last_at TIMESTAMP, last_any_at TIMESTAMP"
TABLES = {
    "episode": f"show_id STRING, episode_id STRING, media BIGINT, {_MEASURES}, day DATE",
    "show": f"show_id STRING, {_MEASURES}, day DATE",
    "touched": "show_id STRING, bucket BIGINT, bits BINARY, day DATE",
}
_SUMS = ("downloads", "streams", "failures", "bytes", "feed_fetches")
_LATEST = ("last_at", "feed_last_at", "last_any_at")
# Parts in which the episodes of one show are numbered.
_BLOCKS = 256


def per_day(log: DataFrame, zone: str) -> DataFrame:
    """Counters per local day, show and episode; rows without one are a group of their own."""
    at = F.col("requested_at")
    is_feed = (F.col("kind") == "feed") & succeeded()
    return log.groupBy(local_date(at, zone).alias("day"), "show_id", "episode_id").agg(
        *named(media_measures()),
        F.count_if(is_media()).alias("media"),
        F.count_if(is_feed).alias("feed_fetches"),
        F.max(F.when(is_media(), at)).alias("last_at"),
        F.max(F.when(is_feed, at)).alias("feed_last_at"),
        F.max(at).alias("last_any_at"),
    )


def _united() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in _SUMS], *[F.max(c).alias(c) for c in _LATEST]]


class DayGrain:
    """The tables under one folder, by the days of one zone."""

    def __init__(self, spark: SparkSession, root: str, zone: str):
        self.spark, self.root, self.zone = spark, root.rstrip("/"), zone

    def _read(self, name: str, schema: str) -> DataFrame:
        columns = self.spark.createDataFrame([], schema).columns
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}").select(*columns)
        except AnalysisException as err:
            if err.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def table(self, name: str, first: date | None = None, last: date | None = None) -> DataFrame:
        """One of the tables, for days of ``[first, last)``; whole folders are passed over."""
        rows = self._read(name, TABLES[name])
        if first is not None:
            rows = rows.where(F.col("day") >= F.lit(first))
        return rows if last is None else rows.where(F.col("day") < F.lit(last))

    # Writing

    def refresh(self, log: DataFrame, days: DataFrame | None = None) -> None:
        """Work days out anew from the log: those in ``days`` (``day``), or all. A day without rows any more goes."""
        if days is not None:
            days = days.select("day").distinct()
            if DAY in log.columns:
                near = days.select(F.explode(F.array(F.date_sub("day", 1), "day", F.date_add("day", 1))).alias(DAY)).distinct()
                log = log.join(near, DAY, "left_semi")
        counted = per_day(log, self.zone)
        if days is not None:
            counted = counted.join(days, "day", "left_semi")
            self._drop(days.join(log.select(local_date(F.col("requested_at"), self.zone).alias("day")), "day", "left_anti"), *TABLES)
        whole = days is None
        self._replace("episode", counted, ["day", "show_id", "episode_id"], whole)
        present = self.table("episode") if whole else self.table("episode").join(days, "day", "left_semi")
        self._replace("show", present.groupBy("day", "show_id").agg(*_united()), ["day", "show_id"], whole)
        touched = present.where("media > 0 AND episode_id IS NOT NULL")
        if not whole:
            self._drop(days.join(touched.select("day"), "day", "left_anti"), "touched")
        self._number(touched)
        numbered = touched.join(self._numbers(), self._same_episode(touched)).groupBy(
            "day", F.col("of_show").alias("show_id"), F.expr("bitmap_bucket_number(number)").alias("bucket")
        )
        bits = numbered.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(number))").alias("bits"))
        self._replace("touched", bits, ["day", "show_id", "bucket"], whole)

    def _replace(self, name: str, rows: DataFrame, order: list[str], whole: bool) -> None:
        columns = self.spark.createDataFrame([], TABLES[name]).columns
        ranged = rows.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
        writer = ranged.write.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic")
        writer.partitionBy("day").parquet(f"{self.root}/{name}")

    def _drop(self, days: DataFrame, *names: str) -> None:
        """Delete folders of days, a few names on the driver."""
        gone = [day for (day,) in days.distinct().collect()]
        for name in names:
            for day in gone:
                remove_folder(f"{self.root}/{name}/day={day.isoformat()}")
            self.spark.catalog.refreshByPath(f"{self.root}/{name}")

    def _numbers(self) -> DataFrame:
        """Every episode's number within its show, from 1, given once and for all."""
        return self._read("numbers", "of_show STRING, of_episode STRING, number BIGINT")

    @staticmethod
    def _same_episode(rows: DataFrame) -> Column:
        return rows["show_id"].eqNullSafe(F.col("of_show")) & (rows["episode_id"] == F.col("of_episode"))

    def _number(self, rows: DataFrame) -> None:
        """Give numbers to episodes that have none. A show may hold most of them, so it is numbered in parts
        whose sizes are summed up first."""
        known = self._numbers()
        wanted = rows.select("show_id", "episode_id").distinct()
        fresh = wanted.join(known, self._same_episode(wanted), "left_anti")
        fresh = fresh.withColumn("block", F.pmod(F.xxhash64("episode_id"), F.lit(_BLOCKS)))
        sizes = fresh.groupBy("show_id", "block").agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("show_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        highest = known.groupBy(F.col("of_show")).agg(F.max("number").alias("highest"))
        starts = sizes.withColumn("before", before)
        starts = starts.join(highest, starts["show_id"].eqNullSafe(highest["of_show"]), "left").select(
            F.col("show_id").alias("in_show"), F.col("block").alias("in_block"), (F.col("before") + F.coalesce("highest", F.lit(0))).alias("start")
        )
        place = F.row_number().over(Window.partitionBy("show_id", "block").orderBy("episode_id"))
        placed = fresh.withColumn("place", place)
        numbered = placed.join(starts, placed["show_id"].eqNullSafe(starts["in_show"]) & (F.col("block") == F.col("in_block")))
        numbered.select(
            F.col("show_id").alias("of_show"), F.col("episode_id").alias("of_episode"), (F.col("start") + F.col("place")).cast("bigint").alias("number")
        ).write.mode("append").parquet(f"{self.root}/numbers/batch={uuid.uuid4().hex}")

    # Figures; they read these tables only

    def episode_totals(self, first: date | None = None, last: date | None = None, show_id: str | None = None) -> DataFrame:
        """As :func:`rollups.episode_totals`, of whole days."""
        rows = self.table("episode", first, last).where("media > 0")
        if show_id:
            rows = rows.where(F.col("show_id") == show_id)
        return rows.groupBy("episode_id").agg(*[F.sum(c).alias(c) for c in COUNTERS], F.max("last_at").alias("last_at"))

    def episodes_touched(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """Distinct episodes with media requests per show: bitmaps united over days, then counted."""
        united = self.table("touched", first, last).groupBy("show_id", "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
        return united.groupBy("show_id").agg(F.sum(F.expr("bitmap_count(bits)")).alias("episodes_touched"))

    def show_rollup(self, first: date | None = None, last: date | None = None) -> DataFrame:
        """As :func:`rollups.show_rollup`, of whole days."""
        sums = self.table("show", first, last).groupBy("show_id").agg(*_united())
        sums = sums.where("last_at IS NOT NULL OR feed_fetches > 0")
        touched = self.episodes_touched(first, last).withColumnRenamed("show_id", "of_show")
        joined = sums.join(touched, sums["show_id"].eqNullSafe(touched["of_show"]), "left")
        return joined.select(
            "show_id", *COUNTERS, F.coalesce("episodes_touched", F.lit(0)).alias("episodes_touched"), "last_at", "feed_fetches", "feed_last_at"
        )

    def show_stats(self, shows: DataFrame, first: date | None = None, last: date | None = None) -> DataFrame:
        dim = shows.select(F.col("id").alias("show_id"), "slug", "title")
        return zero_fill(dim, self.show_rollup(first, last), "show_id", SHOW_COUNTERS)

    def overview(self, first: date | None = None, last: date | None = None, prev_first: date | None = None) -> DataFrame:
        """As :func:`rollups.overview`, of whole days."""
        rows = self.table("show")
        if first is None or prev_first is None:
            return rows.agg(
                *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS], F.max("last_at").alias("last_at"), F.max("last_any_at").alias("last_ever_at")
            )
        period = self.table("show", prev_first, last)
        now = F.col("day") >= F.lit(first)

        def total(c: str, when: Column) -> Column:
            return F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))

        sums = period.agg(
            *[total(c, now).alias(c) for c in COUNTERS], *[total(c, ~now).alias(f"prev_{c}") for c in COUNTERS], F.max(F.when(now, F.col("last_at"))).alias("last_at")
        )
        changes = {f"{c}_change": change_between(F.col(c), F.col(f"prev_{c}")) for c in COUNTERS}
        return sums.withColumns({**changes, "last_ever_at": rows.agg(F.max("last_any_at")).scalar()})

    def daily_series(self, buckets: DataFrame, first: date | None = None, last: date | None = None, show_id: str | None = None) -> DataFrame:
        """As :func:`series.daily_series`, for buckets of whole days of this zone."""
        rows = self.table("show", first, last)
        if show_id:
            rows = rows.where(F.col("show_id") == show_id)
        by_day = rows.groupBy("day").agg(*[F.sum(c).alias(c) for c in COUNTERS]).withColumnRenamed("day", "local_date")
        per_bucket = by_day.join(bucket_days(buckets), "local_date").groupBy("idx").agg(*[F.sum(c).alias(c) for c in COUNTERS])
        return zero_fill(buckets.drop("next_key"), per_bucket, "idx", COUNTERS)
