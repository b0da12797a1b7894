"""Byte sizes, intervals and period-over-period change."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB", "TB")


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def format_bytes(n: Column) -> Column:
    """Binary units with one decimal, whole bytes without."""
    value = n.cast("double")
    out = F.format_string("%.1f TB", value / F.lit(float(1024**4)))
    for power in (3, 2, 1):
        scaled = F.format_string(f"%.1f {UNITS[power]}", value / F.lit(float(1024**power)))
        out = F.when(value < float(1024 ** (power + 1)), scaled).otherwise(out)
    out = F.when(value < 1024.0, F.format_string("%.0f B", value)).otherwise(out)
    return F.when(n.isNull(), "—").otherwise(out)


def interval_text(seconds: Column) -> Column:
    minutes = round_half_up(seconds / 60)
    hours = seconds / F.lit(3600.0)
    whole = F.when(hours == F.floor(hours), F.floor(hours).cast("string")).otherwise(
        F.format_string("%.1f", hours)
    )
    return (
        F.when(seconds.isNull(), "—")
        .when(seconds < 120, F.concat(seconds.cast("string"), F.lit(" sec")))
        .when(minutes < 120, F.concat(minutes.cast("string"), F.lit(" min")))
        .otherwise(F.concat(whole, F.lit(" h")))
    )


def change_between(current: Column, previous: Column) -> Column:
    """Absolute and relative change; NULL without a previous figure, no percentage from zero."""
    absolute = current - previous
    percent = F.when(previous != 0, absolute / previous * 100)
    direction = F.when(absolute == 0, "flat").when(absolute > 0, "up").otherwise("down")
    return F.when(
        previous.isNotNull(),
        F.struct(
            absolute.alias("absolute"),
            previous.alias("previous"),
            percent.alias("percent"),
            direction.alias("direction"),
        ),
    )


def change_text(change: Column, higher_is_better: bool = True, period: str = "the previous period") -> Column:
    """Tone and label of one change, as a struct."""
    direction, absolute, percent = change["direction"], change["absolute"], change["percent"]
    good = direction == ("up" if higher_is_better else "down")
    tone = F.when(direction == "flat", "flat").when(good, "good").otherwise("bad")
    plain = F.concat(F.when(absolute > 0, "+").otherwise(""), F.format_number(absolute, 0))
    share = F.concat(
        F.when(percent > 0, "+").otherwise("−"),
        F.format_number(F.abs(round_half_up(percent)), 0),
        F.lit("%"),
    )
    size = F.when(direction == "flat", "no change").when(percent.isNull(), plain).otherwise(share)
    label = F.concat(size, F.lit(f" vs {period}"))
    return F.when(change.isNotNull(), F.struct(tone.alias("tone"), label.alias("label")))
