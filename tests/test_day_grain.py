from __future__ import annotations

from datetime import date, timedelta
from pathlib import Path

from conftest import at
from pyspark.sql import functions as F
from test_access import log_of

from medialog.functions.calendar import calendar_buckets
from medialog.operators import rollups, series
from medialog.plans.day_grain import TABLES, DayGrain

BASE = at("2024-03-01T00:00:00")
ZONE = "UTC"


def some_log(spark, n=400):
    kinds = ("download", "stream", "feed", "cover")
    rows = [
        (i, (i * 37) % (1440 * 6), kinds[i % 4], (200, 206, 304, 500)[i % 5 % 4], i, 9, None,
         None if i % 4 > 1 or i % 50 == 0 else f"e{i % 13}", None if i % 29 == 0 else f"s{i % 3}")
        for i in range(n)
    ]
    return log_of(spark, rows)


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    assert sorted(a.select(*b.columns).collect(), key=str) == sorted(b.collect(), key=str)


def files(root, day):
    return sorted(p.name for t in TABLES for p in Path(root, t, f"day={day}").glob("*.parquet"))


def test_periods_add_up(spark, scratch):
    log = some_log(spark)
    grain = DayGrain(spark, scratch, ZONE)
    grain.refresh(log)
    for first, last in ((1, 4), (2, 3), (1, 7), (6, 9)):
        days = date(2024, 3, first), date(2024, 3, last)
        period = BASE + timedelta(days=first - 1), BASE + timedelta(days=last - 1)
        same(grain.show_rollup(*days), rollups.show_rollup(log, *period))
        same(grain.episode_totals(*days), rollups.episode_totals(log, *period))
        same(grain.episode_totals(*days, show_id="s1"), rollups.episode_totals(log, *period, show_id="s1"))
    same(grain.show_rollup(), rollups.show_rollup(log))
    same(grain.overview(), rollups.overview(log))
    now = [BASE + timedelta(days=d) for d in (3, 6, 0)]
    same(grain.overview(date(2024, 3, 4), date(2024, 3, 7), date(2024, 3, 1)), rollups.overview(log, *now))
    bounds = spark.range(1).select(F.lit(BASE).cast("timestamp").alias("frm"), F.lit(BASE + timedelta(days=6)).cast("timestamp").alias("to"))
    buckets = calendar_buckets(bounds, ZONE)
    same(grain.daily_series(buckets), series.daily_series(log, buckets, ZONE))


def test_figures_read_days_and_not_the_log(spark, scratch):
    some_log(spark).write.parquet(f"{scratch}/log")
    grain = DayGrain(spark, f"{scratch}/grain", ZONE)
    grain.refresh(spark.read.parquet(f"{scratch}/log"))
    figures = grain.show_rollup(date(2024, 3, 2), date(2024, 3, 3))
    read = {f.split("/grain/")[1] for f in figures.inputFiles()}
    assert all("/grain/" in f for f in figures.inputFiles())
    plan = figures._jdf.queryExecution().explainString(figures._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert plan.count("PartitionFilters: [isnotnull(day") == 2 and any("touched/" in f for f in read)


def test_a_late_day_is_replaced_alone(spark, scratch):
    log = some_log(spark)
    late = (F.to_date("requested_at") == date(2024, 3, 2)) & (F.col("id") % 2 == 1)
    grain = DayGrain(spark, scratch, ZONE)
    grain.refresh(log.where(~late))
    numbers = {(r.of_show, r.of_episode): r.number for r in grain._numbers().collect()}
    before = {day: files(scratch, f"2024-03-0{day}") for day in range(1, 7)}
    for _ in range(2):  # a repeated refresh changes nothing
        grain.refresh(log, log.where(late).select(F.to_date("requested_at").alias("day")))
        same(grain.show_rollup(), rollups.show_rollup(log))
    after = {day: files(scratch, f"2024-03-0{day}") for day in range(1, 7)}
    assert [day for day in before if before[day] != after[day]] == [2]
    found = grain._numbers().collect()
    assert len({(r.of_show, r.of_episode) for r in found}) == len(found) == len({(r.of_show, r.number) for r in found})
    assert all(n == numbers.get((r.of_show, r.of_episode), n) for r in found for n in [r.number])


def test_days_that_lose_their_rows(spark, scratch):
    log = some_log(spark)
    day = F.to_date("requested_at")
    grain = DayGrain(spark, scratch, ZONE)
    grain.refresh(log)
    # One day goes, another keeps feed requests only.
    left = log.where((day != date(2024, 3, 2)) & ((day != date(2024, 3, 4)) | (F.col("kind") == "feed")))
    grain.refresh(left, spark.createDataFrame([(date(2024, 3, 2),), (date(2024, 3, 4),)], "day date"))
    same(grain.show_rollup(), rollups.show_rollup(left))
    same(grain.overview(), rollups.overview(left))
    grain.refresh(left.where(day > date(2024, 3, 3)))  # all days anew
    same(grain.show_rollup(), rollups.show_rollup(left.where(day > date(2024, 3, 3))))


def test_a_show_of_more_episodes_than_a_bitmap_holds(spark, scratch):
    at_ = (F.lit(BASE).cast("timestamp") + F.make_dt_interval(days=(F.col("id") % 3).cast("int"))).alias("requested_at")
    rows = spark.range(100_000).select(
        "id", F.concat(F.lit("e"), (F.col("id") % 40_000).cast("string")).alias("episode_id"), F.lit("s").alias("show_id"), at_,
        F.lit("download").alias("kind"), F.lit(200).alias("status_code"), F.col("id").alias("bytes_sent"),
    )
    grain = DayGrain(spark, scratch, ZONE)
    grain.refresh(rows)
    assert grain.show_rollup().first().episodes_touched == 40_000
    assert grain._numbers().agg(F.min("number"), F.max("number"), F.count_distinct("number")).first() == (1, 40_000, 40_000)
    assert grain.table("touched").select("bucket").distinct().count() == 2


def test_nothing(spark, scratch):
    grain = DayGrain(spark, scratch, ZONE)
    assert grain.show_rollup().count() == 0 and grain.overview().first().downloads == 0
    grain.refresh(log_of(spark, []))
    assert grain.episode_totals().count() == 0
