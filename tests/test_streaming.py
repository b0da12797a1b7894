from __future__ import annotations

from datetime import timedelta

from conftest import at
from pyspark.sql import functions as F
from test_access import BASE, log_of

from medialog.functions.moments import local_date
from medialog.operators.rollups import COUNTERS
from medialog.operators.series import daily_totals
from medialog.operators.signin import trailing_failures
from medialog.schemas import LOGIN_ATTEMPTS, MEDIA_ACCESS, RAW_REQUESTS
from medialog.sources.files import subfolders
from medialog.sources.requests import enrich_requests
from medialog.sources.store import read_log
from medialog.streaming import daily, feed_versions, ingest, signin_alerts


def raw(spark, ids):
    row = spark.createDataFrame([(i,) for i in ids], "request_id BIGINT")
    return row.select(
        "request_id", (F.lit(BASE).cast("timestamp") + F.make_dt_interval(mins=F.col("request_id").cast("int"))).alias("requested_at"),
        F.lit("s").alias("show_id"), F.lit("e").alias("episode_id"), F.lit("media").alias("route"), F.lit("a.mp3").alias("file_name"),
        (F.col("request_id") % 5 == 0).alias("is_owner"), F.lit("Overcast/1").alias("user_agent"),
        F.when(F.col("request_id") % 2 == 0, "bytes=0-").alias("range_header"), F.lit(200).alias("status_code"),
        (F.col("request_id") % 7 == 0).alias("aborted"), F.lit(None).cast("bigint").alias("stated_bytes"),
        F.col("request_id").alias("content_length"), F.lit(9).cast("bigint").alias("total_bytes"), F.lit(None).cast("string").alias("error"),
    )


def test_ingest_equals_batch_and_survives_repeats(spark, scratch):
    ids = list(range(1, 40))
    raw(spark, ids).coalesce(1).write.mode("append").json(f"{scratch}/in")

    def drain():
        stream = ingest.raw_stream(spark, f"{scratch}/in", files_per_batch=1)
        ingest.ingest(stream, f"{scratch}/log", f"{scratch}/check").awaitTermination()

    drain()
    # A second delivery: repeats, new rows, and one that is a day late.
    raw(spark, [30, 35, 39, 40, 41, -1440]).coalesce(1).write.mode("append").json(f"{scratch}/in")
    drain()
    log = read_log(spark, f"{scratch}/log").select(*spark.createDataFrame([], MEDIA_ACCESS).columns)
    got = log.orderBy("id").collect()
    batch = spark.read.schema(RAW_REQUESTS).json(f"{scratch}/in").dropDuplicates(["request_id"])
    assert got == enrich_requests(batch).orderBy("id").collect()
    assert len(got) == len({r.id for r in got}) == enrich_requests(batch).count()


def test_responses_without_an_id_are_all_kept(spark, scratch):
    rows = raw(spark, [1, 1, 2, 3, 4]).withColumn("request_id", F.when(F.col("request_id") < 3, F.col("request_id")))
    rows.coalesce(1).write.json(f"{scratch}/in")
    ingest.ingest(ingest.raw_stream(spark, f"{scratch}/in"), f"{scratch}/log", f"{scratch}/check").awaitTermination()
    assert sorted((r.id or 0) for r in read_log(spark, f"{scratch}/log").collect()) == [0, 0, 1, 2]


def test_outcomes(spark):
    rows = {r.id: r for r in enrich_requests(raw(spark, [1, 2, 7, 10])).collect()}
    assert set(rows) == {1, 2, 7}
    assert (rows[1].kind, rows[2].kind, rows[1].bytes_sent, rows[1].client) == ("download", "stream", 1, "Overcast")
    assert rows[7].bytes_sent is None and "hung up" in rows[7].error


def test_daily_totals_follow_late_rows(spark, scratch):
    zone = "Asia/Kolkata"
    first = log_of(spark, [(i, i * 13, ("download", "stream", "feed")[i % 3], 200 if i % 4 else 500, i, 9, None, "e", f"s{i % 2}") for i in range(300)])
    late = log_of(spark, [(901, -3000, "stream", 200, 5, 9, None, "e", "s1"), (900, 299 * 13 - 30, "download", 200, 5, 9, None, "e", "s0")])

    def stored():
        return spark.read.schema(MEDIA_ACCESS).parquet(f"{scratch}/log")

    for part in (first, late):
        part.coalesce(1).write.mode("append").parquet(f"{scratch}/log")
        stream = spark.readStream.schema(MEDIA_ACCESS).parquet(f"{scratch}/log")
        daily.follow(stream, stored, f"{scratch}/steps", f"{scratch}/check").awaitTermination()
    got = daily.daily_by_show(daily.read_totals(spark, f"{scratch}/steps"), zone)
    everything = first.unionByName(late)
    want = everything.where(F.col("kind").isin("download", "stream")).groupBy(local_date(F.col("requested_at"), zone).alias("local_date"), "show_id").agg(
        F.count_if((F.col("kind") == "download") & (F.col("status_code") < 400)).alias("downloads"),
        F.sum("bytes_sent").alias("bytes"),
    )
    pick = ["local_date", "show_id", "downloads", "bytes"]
    assert sorted(got.select(*pick).collect()) == sorted(want.select(*pick).collect())
    per_day = daily_totals(everything, zone)
    sums = got.groupBy("local_date").agg(*[F.sum(c).alias(c) for c in COUNTERS])
    assert sorted(sums.select("local_date", *COUNTERS).collect()) == sorted(per_day.select("local_date", *COUNTERS).collect())


def recent_log(spark, rows):
    """Rows of (id, minutes before now, show)."""
    now = F.current_timestamp()
    df = spark.createDataFrame(rows, "id BIGINT, m INT, show_id STRING")
    return df.select(
        "id", F.lit("e").alias("episode_id"), "show_id", (now - F.make_dt_interval(mins=F.col("m"))).alias("requested_at"), F.lit("download").alias("kind"), F.lit(200).alias("status_code"),
        F.lit(3).cast("bigint").alias("bytes_sent"), F.lit(9).cast("bigint").alias("total_bytes"), *[F.lit(None).cast("string").alias(c) for c in ("range_header", "client", "error")],
    )


def test_recent_totals_come_from_state_alone(spark, scratch):
    def never():
        raise AssertionError("the log was read")

    deliveries = ([(1, 0, "a"), (2, 1, "a"), (3, 2000, "b"), (3, 2000, "b")], [(2, 1, "a"), (4, 1, "a"), (5, 1999, None)])
    for part in deliveries:
        recent_log(spark, part).coalesce(1).write.mode("append").parquet(f"{scratch}/log")
        stream = spark.readStream.schema(MEDIA_ACCESS).parquet(f"{scratch}/log")
        daily.follow(stream, never, f"{scratch}/steps", f"{scratch}/check").awaitTermination()
    sums = daily.read_totals(spark, f"{scratch}/steps").groupBy("show_id").agg(F.sum("downloads"), F.sum("bytes")).collect()
    assert {tuple(r) for r in sums} == {("a", 3, 9), ("b", 1, 3), (None, 1, 3)}


def test_recent_responses_are_told_apart_without_the_log(spark, scratch, monkeypatch):
    def recent(ids):
        # Far from midnight or not, the days do not matter: nothing is compared.
        return raw(spark, ids).withColumn("requested_at", F.current_timestamp() - F.make_dt_interval(mins=F.col("request_id").cast("int")))

    compared = []
    real = ingest.not_stored
    monkeypatch.setattr(ingest, "not_stored", lambda rows, log: compared.append(rows.count()) or real(rows, log))
    for ids in ([1, 2, 3, 3, 4], [3, 4, 6, 6], [1, 6, 7, 8]):
        recent(ids).coalesce(1).write.mode("append").json(f"{scratch}/in")
        ingest.ingest(ingest.raw_stream(spark, f"{scratch}/in"), f"{scratch}/log", f"{scratch}/check").awaitTermination()
    assert sorted(r.id for r in read_log(spark, f"{scratch}/log").collect()) == [1, 2, 3, 4, 6, 7, 8]
    assert compared == [4]  # the first batch of a checkpoint
    # Days late, and long after its id has left the state: the log says so.
    raw(spark, [-1441, 9, 9]).coalesce(1).write.mode("append").json(f"{scratch}/in")
    raw(spark, [-1441, 9]).coalesce(1).write.mode("append").json(f"{scratch}/in2")
    for name in ("in", "in2"):
        ingest.ingest(ingest.raw_stream(spark, f"{scratch}/{name}"), f"{scratch}/log", f"{scratch}/check-{name}", name).awaitTermination()
    assert sorted(r.id for r in read_log(spark, f"{scratch}/log").where("id < 0 OR id > 8").collect()) == [-1441, 9]


def test_old_rows_are_counted_without_state(spark, scratch):
    # Years old, some of them twice in a delivery and in two.
    for ids in ([1, 2, 2, 3, 4, -1440, 6], [3, 4, 6, 7, 7, -1440]):
        raw(spark, ids).repartition(3).write.mode("append").json(f"{scratch}/in")
        ingest.ingest(ingest.raw_stream(spark, f"{scratch}/in"), f"{scratch}/log", f"{scratch}/ingested").awaitTermination()
        stream = daily.log_stream(spark, f"{scratch}/log")
        query = daily.follow(stream, lambda: read_log(spark, f"{scratch}/log"), f"{scratch}/steps", f"{scratch}/check")
        query.awaitTermination()
        assert [op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"] if op["numRowsUpdated"]] == []
    sums = daily.read_totals(spark, f"{scratch}/steps").agg(F.sum("downloads"), F.sum("streams")).first()
    assert tuple(sums) == (3, 3)


def test_one_id_with_two_times_counts_once(spark, scratch):
    twice = raw(spark, [1]).union(raw(spark, [1]).withColumn("requested_at", F.current_timestamp()))
    for rows in (twice, raw(spark, [1, 2])):
        rows.repartition(2).write.mode("append").json(f"{scratch}/in")
        ingest.ingest(ingest.raw_stream(spark, f"{scratch}/in"), f"{scratch}/log", f"{scratch}/check").awaitTermination()
    assert [r.id for r in read_log(spark, f"{scratch}/log").where("id = 1").collect()] == [1]


def test_deliveries_are_written_by_all_tasks(spark, scratch):
    from medialog.registry.streams import _ingest_deliveries

    _ingest_deliveries(raw(spark, range(1, 40)).repartition(4), scratch, f"{scratch}/check")
    assert len(spark.read.parquet(f"{scratch}/in").inputFiles()) > 3
    assert read_log(spark, f"{scratch}/log").count() == len({i for i in range(1, 40) if i % 5})


def test_version_state_is_monotone(spark, scratch):
    t = at("2024-01-01T00:00:00")
    batches = [
        [("s", "v1", t, t)], [("s", "v1", t - timedelta(days=3), t + timedelta(days=1))],
        [("s", "v2", t - timedelta(days=3), t + timedelta(days=2)), ("z", "v1", t, t)],
        [("s", "v3", t + timedelta(days=9), t + timedelta(days=10)), ("s", "vX", t, t + timedelta(days=9))],
    ]
    times = []
    for rows in batches:
        spark.createDataFrame(rows, feed_versions.OBSERVED).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        stream = spark.readStream.schema(feed_versions.OBSERVED).parquet(f"{scratch}/in")
        feed_versions.follow_versions(stream, f"{scratch}/state", f"{scratch}/check").awaitTermination()
        state = {r.show_id: r for r in feed_versions.read_state(spark, f"{scratch}/state").collect()}
        times.append(state["s"].modified_at)
    assert times == [t, t, t + timedelta(days=2), t + timedelta(days=9)]
    assert state["s"].version == "v3" and state["z"].modified_at == t
    # A batch writes what it changed: nothing in the second, shows s and z in the third.
    changes = [spark.read.parquet(f"{scratch}/state/changes-{k}").count() for k in range(4)]
    assert changes == [1, 0, 2, 1]
    feed_versions.settle(spark, f"{scratch}/state")
    assert subfolders(f"{scratch}/state") == ["none", "settled-3-1"]
    assert {r.show_id: r for r in feed_versions.read_state(spark, f"{scratch}/state").collect()} == state
    # The keyed state is in the checkpoint: the job goes on from it.
    spark.createDataFrame([("z", "v1", t, t + timedelta(days=20)), ("s", "v4", t, t + timedelta(days=20))], feed_versions.OBSERVED).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
    stream = spark.readStream.schema(feed_versions.OBSERVED).parquet(f"{scratch}/in")
    feed_versions.follow_versions(stream, f"{scratch}/state", f"{scratch}/check").awaitTermination()
    state = {r.show_id: (r.version, r.modified_at) for r in feed_versions.read_state(spark, f"{scratch}/state").collect()}
    assert state == {"s": ("v4", t + timedelta(days=20)), "z": ("v1", t)}


def test_a_busy_show_sends_few_rows_to_its_state(spark, scratch):
    t = F.lit(BASE).cast("timestamp")
    rows = spark.range(5_000).select(
        F.lit("busy").alias("show_id"), F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("version"), t.alias("last_build_at"),
        (t + F.make_dt_interval(secs=F.col("id").cast("int"))).alias("observed_at"),
    )
    rows.coalesce(1).write.parquet(f"{scratch}/in")
    query = feed_versions.follow_versions(spark.readStream.schema(feed_versions.OBSERVED).parquet(f"{scratch}/in"), f"{scratch}/state", f"{scratch}/check")
    query.awaitTermination()
    assert [r.version for r in feed_versions.read_state(spark, f"{scratch}/state").collect()] == ["v04999"]
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]) <= 2


def test_alerts_equal_trailing_failures_at_window_ends(spark, scratch):
    t = at("2024-01-01T00:00:30")
    minutes = [0, 1, 2, 14, 15, 16, 40, 41, 300]
    rows = [(i, "u", t + timedelta(minutes=m, seconds=i), 0, None) for i, m in enumerate(minutes)]
    attempts = spark.createDataFrame(rows, LOGIN_ATTEMPTS)
    attempts.coalesce(1).write.parquet(f"{scratch}/in")
    stream = spark.readStream.schema(LOGIN_ATTEMPTS).parquet(f"{scratch}/in")
    signin_alerts.watch(stream, f"{scratch}/out", f"{scratch}/check").awaitTermination()
    got = {r.window_end: r.failures for r in spark.read.parquet(f"{scratch}/out").collect()}
    for end, n in got.items():
        assert n == sum(end - timedelta(minutes=15) <= r[2] < end for r in rows) >= 2
    trailing = {r.attempted_at: r.trailing_failures for r in trailing_failures(attempts).collect()}
    # At the next full minute a window ends that holds the same failures.
    for when, n in trailing.items():
        if n >= 2:
            assert got[when.replace(second=0) + timedelta(minutes=1)] == n


def test_attempts_equal_trailing_failures(spark, scratch):
    t = at("2024-01-01T00:00:30")
    seconds = [0, 30, 30, 90, 700, 930, 931, 932, 932, 2000, 2600, 5000, 5001]
    rows = [(i, ("u", "v")[i % 5 == 4], t + timedelta(seconds=s), int(i in (5, 9)), None) for i, s in enumerate(seconds)]
    rows += [(99, "z", t + timedelta(hours=9), 0, None)]  # moves the watermark past the rest
    df = spark.createDataFrame(rows, LOGIN_ATTEMPTS)
    # In two deliveries, the second with rows older than some of the first, within the lateness.
    for ids in ([0, 1, 3, 5], [2, 4, 6, 7, 8], [9, 10, 11, 12], [99]):
        df.where(F.col("id").isin(ids)).coalesce(1).write.mode("append").parquet(f"{scratch}/in")
        stream = spark.readStream.schema(LOGIN_ATTEMPTS).parquet(f"{scratch}/in")
        signin_alerts.watch_attempts(stream, f"{scratch}/out", f"{scratch}/check", threshold=0, lateness="20 minutes").awaitTermination()
    got = {r.id: r for r in spark.read.parquet(f"{scratch}/out").collect()}
    want = {r.id: r.trailing_failures for r in trailing_failures(df).collect() if r.id != 99}
    assert {k: r.trailing_failures for k, r in got.items()} == want
    for i, user, when, _, _ in rows[:-1]:
        own = sorted(r for r in rows if r[1] == user and (r[2], r[0]) <= (when, i) and r[2] >= when - timedelta(minutes=15))
        n = 0
        for r in sorted(own, key=lambda r: (r[2], r[0])):
            n = 0 if r[3] else n + 1
        assert got[i].failures == n, i


def test_one_user_over_many_blocks(spark, scratch):
    """Every minute of a day once; a row without a time and one without an outcome do no harm."""
    t = at("2024-01-01T00:00:10")
    rows = [(i, "u", t + timedelta(seconds=17 * i), int(i % 29 == 0), None) for i in range(5000)]
    rows += [(7000, "u", None, 0, None), (7001, "u", t + timedelta(minutes=59), None, None), (7002, "z", t + timedelta(days=3), 0, None)]
    df = spark.createDataFrame(rows, LOGIN_ATTEMPTS)
    df.coalesce(1).write.parquet(f"{scratch}/in")
    stream = spark.readStream.schema(LOGIN_ATTEMPTS).parquet(f"{scratch}/in")
    signin_alerts.watch_attempts(stream, f"{scratch}/out", f"{scratch}/check", threshold=0).awaitTermination()
    got = {r.id: (r.trailing_failures, r.failures, r.succeeded) for r in spark.read.parquet(f"{scratch}/out").collect()}
    timed = sorted((r for r in rows if r[2] and r[1] == "u"), key=lambda r: (r[2], r[0]))
    assert set(got) == {r[0] for r in timed}
    for k, (i, _, when, succeeded, _) in enumerate(timed):
        window = [r for r in timed[max(0, k - 60) : k + 1] if r[2] >= when - timedelta(minutes=15)]
        since = [r for r in window if all(not (s[3] == 1 and (s[2], s[0]) >= (r[2], r[0])) for s in window)]
        assert got[i] == (sum(r[3] == 0 for r in window), sum(r[3] == 0 for r in since), succeeded), i
