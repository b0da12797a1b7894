"""The salted route gives what a plain join gives, NULL and hot keys included."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from medialog.operators import joins


@pytest.fixture
def sides(spark):
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    facts = spark.range(3000).withColumn("k", key)
    lookup = spark.range(40).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").alias("v"))
    return facts, lookup.unionByName(spark.sql("SELECT 'hot' AS k, CAST(-1 AS BIGINT) AS v"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows(spark, sides, how):
    facts, lookup = sides
    want = sorted(map(str, facts.join(lookup, ["k"], how).collect()))
    assert sorted(map(str, joins.lookup_join(facts, lookup, ["k"], ["id"], how).collect())) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        salted = joins.lookup_join(facts, lookup, ["k"], ["id"], how, salts=8)
        assert sorted(map(str, salted.collect())) == want
        assert salted.columns == facts.join(lookup, ["k"], how).columns
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_hot_and_null_keys_are_spread(spark, sides):
    facts, lookup = sides
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = joins.lookup_join(facts, lookup, ["k"], ["id"], "left", salts=16).withColumn("task", F.spark_partition_id())
        for rows in (out.where("k = 'hot'"), out.where("k IS NULL")):
            assert rows.select("task").distinct().count() >= 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_joins_are_left_to_spark_by_default(spark, sides):
    facts, lookup = sides
    assert "__salt" not in joins.lookup_join(facts, lookup, ["k"], ["id"])._jdf.queryExecution().toString()
