"""Registration of queries with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medialog.session import configure
from medialog.sources.fixtures import oracle, table

# The fixed clock of every clock-dependent query, inside the range of the log.
NOW = datetime(2024, 1, 30, 12, 0, 0)
FRM = datetime(2024, 1, 10)
TO = datetime(2024, 1, 25)


class Tables:
    """Lazy access to the tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def plain_values(df: DataFrame) -> DataFrame:
    """Instants as UTC wall-clock values and days as text, so that every reader sees the same."""

    def plain(field: T.StructField):
        if isinstance(field.dataType, T.TimestampType):
            return F.col(field.name).cast("timestamp_ntz").alias(field.name)
        if isinstance(field.dataType, T.DateType):
            return F.col(field.name).cast("string").alias(field.name)
        return F.col(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


@dataclass
class Registry:
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None, views: tuple[str, ...] = (), days: tuple[str, ...] = ()):
        """Decorator: register a function of :class:`Tables`. ``days`` names date columns."""

        def wrap(build: Callable[[Tables], DataFrame]):
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                configure(spark)
                return plain_values(build(Tables(spark, sf_dir)))

            self.queries[name] = run
            if sql is not None:
                text = oracle(sql, *views)
                if days:
                    casts = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in days)
                    text = f"SELECT * REPLACE ({casts}) FROM ({text})"
                self.oracles[name] = text
            return build

        return wrap


REGISTRY = Registry()
