"""Chart series over calendar buckets, and client shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialog.functions.calendar import bucket_days, calendar_buckets
from medialog.functions.moments import instant, local_date
from medialog.functions.numbers import round_half_up
from medialog.operators.access_log import is_media, within
from medialog.operators.rollups import COUNTERS, media_measures, named, zero_fill


def chart_bounds(log: DataFrame, now_bound) -> DataFrame:
    """Bounds of the all-time chart: first request to the given upper bound."""
    return log.agg(F.min("requested_at").alias("frm")).select("frm", instant(now_bound).alias("to"))


def daily_totals(log: DataFrame, zone: str, frm=None, to=None, show_id: str | None = None) -> DataFrame:
    """Counters per local day."""
    rows = within(log, frm, to).where(is_media())
    if show_id:
        rows = rows.where(F.col("show_id") == show_id)
    return rows.groupBy(local_date(F.col("requested_at"), zone).alias("local_date")).agg(*named(media_measures()))


def daily_series(log: DataFrame, buckets: DataFrame, zone: str, frm=None, to=None, show_id=None) -> DataFrame:
    """Counters per bucket, empty ones included.

    A range join of buckets to the log would be a nested loop over the facts. Bucket edges are
    local midnights, so the log is first reduced to local days, which then meet their bucket
    by equality.
    """
    per_bucket = (
        daily_totals(log, zone, frm, to, show_id)
        .join(bucket_days(buckets), "local_date")
        .groupBy("idx")
        .agg(*[F.sum(c).alias(c) for c in COUNTERS])
    )
    return zero_fill(buckets.drop("next_key"), per_bucket, "idx", COUNTERS)


def series_for_range(log: DataFrame, bounds: DataFrame, zone: str, frm=None, to=None, show_id=None) -> DataFrame:
    return daily_series(log, calendar_buckets(bounds, zone), zone, frm, to, show_id)


def scale_series(series: DataFrame, measures: list[str]) -> DataFrame:
    """Stacked total per bucket and each measure as a share of the tallest bucket."""
    total = sum((F.col(m) for m in measures[1:]), F.col(measures[0]))
    stacked = series.withColumn("total", total)
    tallest = stacked.agg(F.max("total")).scalar()
    shares = {
        f"{m}_pct": F.when(tallest == 0, 0.0).otherwise(F.col(m) / tallest * 100) for m in measures
    }
    return stacked.withColumns(shares)


def series_summary(series: DataFrame, measures: list[str]) -> DataFrame:
    """Tallest, middle and grand total, and the peak: the first bucket among equals."""
    total = sum((F.col(m) for m in measures[1:]), F.col(measures[0]))
    stacked = series.withColumn("total", total)
    return stacked.agg(
        F.coalesce(F.max("total"), F.lit(0)).alias("max_total"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("grand_total"),
        F.max_by("label", F.struct(F.col("total"), -F.col("idx"))).alias("peak_label"),
    ).withColumns({"mid": round_half_up(F.col("max_total") / 2), "empty": F.col("max_total") == 0})


def share_bars(rows: DataFrame, label: str, value: str, k: int = 8) -> DataFrame:
    """The k largest positive values: share of the biggest, rounded share of all, and the rest.

    Ranks are taken after the cut, over k rows at most.
    """
    positive = rows.select(
        F.coalesce(F.col(label).cast("string"), F.lit("Unknown")).alias("label"), F.col(value).alias("value")
    ).where(F.col("value") > 0)
    total = positive.agg(F.coalesce(F.sum("value"), F.lit(0))).scalar()
    kept = positive.orderBy(F.desc("value"), F.asc("label")).limit(k)
    order = Window.orderBy(F.desc("value"), F.asc("label"))
    whole = Window.partitionBy()
    return (
        kept.withColumns(
            {
                "rank": F.row_number().over(order),
                "pct": F.col("value") / F.max("value").over(whole) * 100,
                "kept_sum": F.sum("value").over(whole),
                "total": total,
            }
        )
        .withColumns(
            {
                "share": round_half_up(F.col("value") / F.col("total") * 100),
                "other": F.col("total") - F.col("kept_sum"),
                "vague": F.col("label").isin("Unknown", "Other"),
            }
        )
        .drop("kept_sum")
    )
