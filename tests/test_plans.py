"""Shapes of plans that must hold at any size."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F
from test_access import BASE, log_of
from test_feeds import shows
from test_reconcile import episodes

from medialog.operators import access_log, rollups, scan_log, signin
from medialog.operators.series import series_for_range
from medialog.schemas import LOGIN_ATTEMPTS
from medialog.sources.store import Store


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, scratch):
    store = Store(spark, scratch)
    store.append_access(log_of(spark, [(i, i * 60, "download", 200, 1, 1, "Castro", "e", "s") for i in range(100)]))
    return store.access_log()


def test_rollups_read_the_columns_and_days_they_need(spark, scratch):
    text = plan(rollups.episode_totals(stored(spark, scratch), BASE, BASE + timedelta(days=1)))
    assert "ReadSchema: struct<episode_id:string,requested_at:timestamp,kind:string,status_code:int,bytes_sent:bigint>" in text
    assert "PartitionFilters: [isnotnull(requested_date" in text and "In(kind, [download,stream])" in text
    assert text.count("Exchange") == 1 and "partial_sum" in text


def test_pages_are_cut_before_titles_are_joined(spark, scratch):
    text = plan(access_log.list_log(stored(spark, scratch), episodes(spark), shows(spark), limit=40))
    assert text.index("Join") < text.index("TakeOrderedAndProject(limit=40"), "joins sit above the cut"


def test_feed_fetch_stays_in_hash_aggregates_over_the_log(spark, scratch):
    text = plan(rollups.last_feed_fetch(stored(spark, scratch)))
    lines = [ln for ln in text.splitlines() if "Aggregate" in ln]
    assert "HashAggregate" in lines[-1] and "SortAggregate" not in lines[-1]


def test_series_never_compare_ranges(spark, scratch):
    log = stored(spark, scratch)
    bounds = log.agg(F.min("requested_at").alias("frm"), F.max("requested_at").alias("to"))
    text = plan(series_for_range(log, bounds, "Europe/London"))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_trailing_failures_split_users_by_hour(spark):
    attempts = spark.createDataFrame([(1, "u", BASE, 0, None)], LOGIN_ATTEMPTS)
    assert "hashpartitioning(username" in plan(signin.trailing_failures(attempts))
    assert "block#" in plan(signin.trailing_failures(attempts)).split("hashpartitioning(username")[1].split(")")[0]


def test_capped_diagnostics_limit_groups_before_the_shuffle(spark):
    word = F.col("id").cast("string")
    rows = spark.range(10_000).select(*[word.alias(c) for c in ("show_id", "level", "file", "message", "code")])
    text = plan(scan_log.capped_diagnostics(rows, ["show_id", "level"], ["file"]))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_figures_of_shows_scan_the_log_once(spark, scratch):
    store = Store(spark, scratch)
    store.append_access(log_of(spark, [(i, i * 60, ("download", "feed")[i % 2], 200, 1, 1, "Castro", "e", "s") for i in range(20)]))
    plan = rollups.show_figures(store.access_log())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_copies_of_one_file_are_spread(spark):
    from test_reconcile import files

    from medialog.operators.reconcile import claim_identities, duplicate_files

    # Half of the files have one identity.
    rows = files(spark, *[dict(filename=f"{k}.mp3", identity_key="same" if k % 2 else str(k)) for k in range(40)])
    matched = rows.withColumns({"fast": F.lit(False), "mime_type": F.lit("audio/mpeg")})
    found = duplicate_files(matched, claim_identities(matched, episodes(spark)))
    assert found.count() == 19 and "__salt" in plan(found)
