"""Joining large facts to keyed lookup tables without a hot partition.

As a rule the join is left to Spark: it broadcasts a side whose size it knows to be small, and
otherwise splits the partitions of a hot key as it runs. It does not where a side was grouped by the same key in the
same stage; there, ``salts`` spreads the facts of every key, NULL included, over a range that the lookup side is copied to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Deal rows evenly over the tasks, by columns that differ from row to row.

    A file may be one row group, which one task reads alone. What is worked out or sorted for each of its rows before they
    next move would be that task's alone too.
    """
    return rows.repartition(F.xxhash64(*by))


_SALT = "__salt"
_SALTABLE = ("inner", "left", "left_semi", "left_anti")


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    salts: int | None = None,
) -> DataFrame:
    """Join ``facts`` to ``lookup`` on equally named columns.

    ``spread_by`` names fact columns that differ inside a hot key, such as the row id; with ``salts``
    the facts are spread by them.
    """
    if how not in _SALTABLE:
        raise ValueError(f"how must be one of {_SALTABLE}")
    if not salts:
        return facts.join(lookup, on, how)
    salted = facts.withColumn(_SALT, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = lookup.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # The hint keeps Spark from broadcasting the copies on a low estimate.
    return salted.join(copies.hint("merge"), [*on, _SALT], how).drop(_SALT)
