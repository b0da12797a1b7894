"""Run registered queries in Spark and DuckDB and compare rows as multisets."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def make_spark() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("medialog-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, decimal.Decimal):
        return repr(float(value)) if value % 1 else str(int(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value if isinstance(value, bool) or value is None else str(value)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, sf_dir: str, counts: dict | None = None) -> list[str]:
    """Differences between the two engines, empty when equal; row counts go to ``counts``."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if counts is not None:
        counts[name] = sum(got.values())
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return [f"columns {sorted(set(df.columns) ^ set(columns))}"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    problems = [f"plan has {bad}" for bad in ("CartesianProduct", "NestedLoopJoin", "BatchEvalPython") if bad in plan]
    spark_types = dict(df.dtypes)
    for name_, kind_ in ((d[0], str(d[1])) for d in cur.description):
        whole = spark_types[name_] in ("bigint", "int", "smallint", "tinyint")
        if whole != (kind_ in ("BIGINT", "INTEGER", "SMALLINT", "TINYINT")) or kind_ == "HUGEINT":
            problems.append(f"type of {name_}: {spark_types[name_]} vs {kind_}")
    if got != want:
        problems.append(f"rows {sum(got.values())} vs {sum(want.values())}")
        problems += [f"  spark only {r}" for r in list((got - want))[:2]]
        problems += [f"  duck only  {r}" for r in list((want - got))[:2]]
    return problems


def main() -> int:
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = make_spark(), duck(sf_dir)
    oracles, bad, counts = entry.oracle_sql(), 0, {}
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracles:
                problems = compare(spark, con, name, query, oracles[name], sf_dir, counts)
                kind = f"ok {counts[name]}"
            else:
                kind, problems = f"rows={query(spark, sf_dir).count()}", []
        except Exception as err:
            problems, kind = [f"{type(err).__name__}: {str(err)[:1200]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else kind:10} {time.time() - start:6.2f}s {name}", *problems, sep="\n     " if problems else " ", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    raise SystemExit(min(main(), 1))
