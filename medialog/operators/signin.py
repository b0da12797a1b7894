"""Sign-in attempts: backoff, trailing failures, retention."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialog.functions.moments import instant
from medialog.operators.joins import lookup_join

WINDOW_MINUTES = 15
# Seconds to wait after so many failures.
BACKOFF_STEPS = (0, 0, 1, 3, 10, 30, 60, 120, 300)


def login_backoff(attempts: DataFrame, now) -> DataFrame:
    """Failures since the last success within the window, and the seconds left to wait."""
    recent = attempts.where(
        (F.col("attempted_at") > instant(now - timedelta(minutes=WINDOW_MINUTES)))
        & (F.col("attempted_at") <= instant(now))
    )
    # A success forgets what came before it.
    reset = recent.where("succeeded = 1").groupBy("username").agg(
        F.max(F.struct("attempted_at", "id")).alias("reset")
    )
    failures = lookup_join(recent.where("succeeded = 0"), reset, ["username"], ["id"]).where(
        F.col("reset").isNull() | (F.struct("attempted_at", "id") > F.col("reset"))
    )
    steps = F.array(*[F.lit(s) for s in BACKOFF_STEPS])
    step = F.element_at(steps, F.least(F.col("failures"), F.lit(len(BACKOFF_STEPS) - 1)).cast("int") + 1)
    elapsed = (F.unix_micros(instant(now)) - F.unix_micros("last_failure_at")) / F.lit(1e6)
    wait = F.greatest(F.lit(0), F.ceil(step - elapsed)).cast("bigint")
    return (
        failures.groupBy("username")
        .agg(F.count("*").alias("failures"), F.max("attempted_at").alias("last_failure_at"))
        .withColumn("wait_seconds", F.when(step == 0, F.lit(0).cast("bigint")).otherwise(wait))
    )


def trailing_failures(attempts: DataFrame, minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Per attempt, the user's failures in the minutes up to it.

    A user may hold a third of all attempts, so the window runs over blocks of that many minutes of
    a user. An attempt counts in its own block and the next, where it is dropped afterwards.
    """
    length = minutes * 60 * 1_000_000
    block = F.floor(F.unix_micros("attempted_at") / length)
    copied = attempts.withColumn("block", F.explode(F.array(block, block + 1))).withColumn("own", F.col("block") == block)
    span = (
        Window.partitionBy("username", "block")
        .orderBy(F.unix_micros("attempted_at"))
        .rangeBetween(-length, 0)
    )
    counted = copied.withColumn("trailing_failures", F.count_if(F.col("succeeded") == 0).over(span))
    return counted.where("own").drop("block", "own")


def trim_attempts(attempts: DataFrame, now, hours: int = 24) -> DataFrame:
    return attempts.where(F.col("attempted_at") >= instant(now - timedelta(hours=hours)))
