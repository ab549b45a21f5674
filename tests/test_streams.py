"""Streaming jobs over many batches: open sessions, the levelled change log, the pruned sink."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dwops.operators import windows as win
from dwops.session import fresh_path
from dwops.streaming import changelog, jobs
from tests.test_rules import rows


def test_written_and_open_sessions_are_all_sessions(spark, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet").withColumn("user_id", F.col("user_id") % 3)
    source, out, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    run = lambda: jobs.stream_sessions(jobs.file_stream(spark, source, events.schema, "ts"), "user_id", "ts", "30 minutes", "1 hour", out, state)
    for first in (1, 11, 21):
        events.where(F.dayofmonth("ts").between(first, first + 10)).where(F.lit(first < 21) | (F.dayofmonth("ts") > 21)).coalesce(1).write.mode("append").parquet(source)
        run()
        # After each run, of the rows taken so far.
        taken = spark.read.schema(events.schema).parquet(source).distinct()
        numbered = win.sessionize(taken, "user_id", "ts", ["event_id"])
        whole = numbered.groupBy("user_id", "session_id").agg(
            F.min("ts").alias("a"), (F.max("ts") + F.expr("interval 30 minutes")).alias("b"), F.count(F.lit(1)).alias("n"))
        still_open = jobs.open_sessions(spark, "user_id", state)
        assert still_open.count() > 0
        found = spark.read.parquet(out).unionByName(still_open)
        if first == 1:
            assert rows(found, "user_id", "session_start", "session_end", "actions") == rows(whole, "user_id", "a", "b", "n")
        assert found.select("user_id", "session_start").distinct().count() == found.count()


# --- change log ------------------------------------------------------------

SCHEMA = "k int, name string, ts int"


def expected(batches, target):
    """Latest change per key: highest ts, of equal ones the last batch."""
    best = {}
    for number, batch in enumerate(batches):
        for k, name, ts in batch:
            if k not in best or (ts, number) >= best[k][:2]:
                best[k] = (ts, number, name)
    return sorted(((k, best[k][2] if k in best else n) for k, n in {**{k: None for k in best}, **dict(target)}.items()), key=repr)


def test_fifty_batches(spark):
    log = fresh_path(spark, "log")
    batches = [[(k, f"{number}-{k}", (number * 7 + k) % 23) for k in range(number % 5, 40, 5)] for number in range(50)]
    for number, batch in enumerate(batches):
        changelog.add_batch(spark.createDataFrame(batch, SCHEMA), number, log, ["k"], ["-ts"], 4)
        changelog.merge_runs(spark, log, ["k"], ["-ts"], 4)
        assert len(changelog.live_runs(spark, log)) <= 3 * 3 + 3
    target = spark.createDataFrame([(1, "a"), (99, "b")], "k int, name string")
    want = expected(batches, [(1, "a"), (99, "b")])
    assert rows(jobs.upserted(target, log, ["k"], order=["-ts"])) == want
    live = changelog.live_runs(spark, log)
    assert [r.first for r in live] == [0, *[r.last + 1 for r in live[:-1]]] and live[-1].last == 49

    changelog.compact(spark, log, ["k"], ["-ts"])
    one = changelog.live_runs(spark, log)
    assert [(r.first, r.last) for r in one] == [(0, 49)]
    assert rows(jobs.upserted(target, log, ["k"], order=["-ts"])) == want
    # A merge reads one folder per bucket, a lookup only the buckets of its keys.
    folders = lambda df: {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    everything = changelog.read_runs(spark, log, one)
    assert len(folders(everything)) == everything.select("bucket").distinct().count() <= 4
    wanted = spark.createDataFrame([(7,), (500,)], "k int")
    found = changelog.latest_changes(spark, log, ["k"], ["-ts"], wanted, 4)
    assert rows(found, "k", "name") == [r for r in want if r[0] == 7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]

    # New batches go on top; what the large run holds may be removed.
    changelog.add_batch(spark.createDataFrame([(7, "newest", 99)], SCHEMA), 50, log, ["k"], ["-ts"], 4)
    changelog.compact(spark, log, ["k"], ["-ts"], remove=True)
    assert len(changelog.complete_runs(spark, log)) == 1
    assert dict(rows(jobs.upserted(target, log, ["k"], order=["-ts"])))[7] == "newest"


def test_a_batch_run_again_changes_nothing(spark):
    log = fresh_path(spark, "log")
    batch = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "n", 1)], SCHEMA)
    for number in (0, 0, 1, 1):
        changelog.add_batch(batch.withColumn("ts", F.col("ts") + number), number, log, ["k"], ["-ts"])
    assert changelog.merge_runs(spark, log, ["k"], ["-ts"], 2) == 1
    changelog.add_batch(batch.withColumn("name", F.lit("late repeat")), 1, log, ["k"], ["-ts"])
    assert [(r.first, r.last) for r in changelog.live_runs(spark, log)] == [(0, 1)]
    assert rows(changelog.latest_changes(spark, log, ["k"], ["-ts"]), "k", "name", "ts") == [(1, "y", 3), (None, "n", 2)]


def test_a_merge_cut_short_does_not_count(spark):
    log = fresh_path(spark, "log")
    for number in range(2):
        changelog.add_batch(spark.createDataFrame([(number, "v", 1)], SCHEMA), number, log, ["k"], ["-ts"])
    # Rows of a merge that never was marked complete.
    spark.createDataFrame([(5, "half", 1, 0, 0)], f"{SCHEMA}, bucket int, batch long").write.partitionBy("bucket").parquet(f"{log}/level=1/run=0-1")
    path, files = changelog._files(spark, f"{log}/level=1/run=0-1/_SUCCESS")
    files.delete(path, False)
    assert rows(changelog.latest_changes(spark, log, ["k"], ["-ts"]), "k") == [(0,), (1,)]
    assert changelog.merge_runs(spark, log, ["k"], ["-ts"], 2) == 1
    assert rows(changelog.latest_changes(spark, log, ["k"], ["-ts"]), "k") == [(0,), (1,)]


def test_empty_batches_and_an_empty_log(spark):
    log = fresh_path(spark, "log")
    target = spark.createDataFrame([(1, "a")], "k int, name string")
    assert rows(jobs.upserted(target, log, ["k"])) == [(1, "a")]
    empty = spark.createDataFrame([], SCHEMA)
    for number in range(3):
        changelog.add_batch(empty, number, log, ["k"], ["-ts"])
    assert rows(jobs.upserted(target, log, ["k"])) == [(1, "a")]
    assert changelog.merge_runs(spark, log, ["k"], ["-ts"], 3) == 1
    changelog.add_batch(spark.createDataFrame([(1, "b", 1)], SCHEMA), 3, log, ["k"], ["-ts"])
    changelog.compact(spark, log, ["k"], ["-ts"])
    assert rows(jobs.upserted(target, log, ["k"])) == [(1, "b")]


# --- incremental sink ------------------------------------------------------

def test_a_batch_reads_only_the_buckets_it_touches(spark):
    source, out, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    schema = "k long, v string"
    run = lambda: jobs.stream_incremental(jobs.file_stream(spark, source, schema), "k", out, state, buckets=16)
    spark.range(400).select(F.col("id").alias("k"), F.lit("first").alias("v")).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([(3, "again"), (3, "again"), (1000, "new"), (None, "no key"), (None, "no key")], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(out)
    assert rows(got.where("batch = 1"), "k", "v") == sorted([(1000, "new"), (None, "no key"), (None, "no key")], key=repr)
    assert rows(got.where("k = 3"), "v") == [("first",)] and got.count() == 403
    touched = [r[0] for r in got.where("k in (3, 1000)").select("bucket").distinct().collect()]
    seen = jobs.loaded_keys(spark, out, spark.createDataFrame([], schema).schema, "k", touched, 1)
    plan = seen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "ReadSchema: struct<k:bigint>" in plan
    assert 0 < seen.count() < 400 * (len(touched) + 3) / 16


def test_a_repeated_load_overwrites_its_own_part(spark):
    source, out, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    spark.range(50).select(F.col("id").alias("k")).write.parquet(source)
    jobs.stream_incremental(jobs.file_stream(spark, source, "k long"), "k", out, state)
    # A second query with its own checkpoint runs batch 0 over the same sink once more.
    jobs.stream_incremental(jobs.file_stream(spark, source, "k long"), "k", out, fresh_path(spark, "state"))
    assert spark.read.parquet(out).count() == 50
