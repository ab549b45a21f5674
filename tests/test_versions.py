"""Versioned dimensions with untracked columns and surrogate keys, repeats in the stage, overlapping pairs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from dwops.operators import loading, temporal
from tests.test_rules import day, rows

DIM = "sk long, k int, name string, tier string, note string, valid_from date, valid_to date, is_current boolean"
OLD, NEW = "1995-01-01", "2000-01-01"


def dim(spark):
    return spark.createDataFrame([
        (1, 1, "ann", "a", "first", day("1990-01-01"), day(OLD), False), (2, 1, "ann", "b", "second", day(OLD), None, True),
        (3, 2, "bob", "a", "kept", day(OLD), None, True), (9, 3, "cy", "c", None, day(OLD), None, True)], DIM)


def test_all_columns_and_surrogate_keys(spark):
    stage = spark.createDataFrame([(1, "ann", "z"), (2, "bob", "a"), (4, "di", "d"), (5, "ed", "e")], "k int, name string, tier string")
    out = temporal.scd2_apply(dim(spark), stage, "k", ["name", "tier"], NEW, surrogate="sk")
    assert out.columns == dim(spark).columns and out.schema == dim(spark).schema
    assert rows(out) == sorted([
        (1, 1, "ann", "a", "first", day("1990-01-01"), day(OLD), False), (2, 1, "ann", "b", "second", day(OLD), day(NEW), False),
        (10, 1, "ann", "z", "second", day(NEW), None, True), (3, 2, "bob", "a", "kept", day(OLD), None, True),
        (9, 3, "cy", "c", None, day(OLD), None, True), (11, 4, "di", "d", None, day(NEW), None, True), (12, 5, "ed", "e", None, day(NEW), None, True)], key=repr)
    # The next load goes on from there.
    again = temporal.scd2_apply(out, stage.where("k = 4").withColumn("tier", F.lit("dd")), "k", ["name", "tier"], "2001-01-01", surrogate="sk")
    assert [r["sk"] for r in again.where("k = 4").orderBy("sk").collect()] == [11, 13]
    assert again.where("is_current").groupBy("k").count().where("count > 1").count() == 0


def test_untracked_columns_come_from_the_stage_with_a_new_version(spark):
    stage = spark.createDataFrame([(1, "ann", "z", "fresh"), (2, "bob", "a", "ignored")], "k int, name string, tier string, note string")
    out = temporal.scd2_apply(dim(spark), stage, "k", ["name", "tier"], NEW)
    assert rows(out.where("k in (1, 2) and is_current"), "k", "tier", "note") == [(1, "z", "fresh"), (2, "a", "kept")]


@pytest.mark.parametrize("apply", [
    lambda d, s: temporal.scd2_apply(d, s, "k", ["name", "tier"], NEW),
    lambda d, s: temporal.scd3_apply(d, s, "k", "tier"),
    lambda d, s: temporal.version_table(d.select("k", "name", "tier", "valid_from", "valid_to", "is_current"), s, "k", NEW),
    lambda d, s: loading.upsert(d, s, ["k"]),
])
def test_a_key_staged_twice_is_refused(spark, apply):
    stage = spark.createDataFrame([(1, "ann", "x"), (1, "ann", "y")], "k int, name string, tier string")
    with pytest.raises(Exception, match="more than once"):
        apply(dim(spark), stage).collect()


def test_rows_without_a_key(spark):
    stage = spark.createDataFrame([(None, "x", "q"), (None, "x", "q"), (2, "bob", "a")], "k int, name string, tier string")
    out = temporal.scd2_apply(dim(spark), stage, "k", ["name", "tier"], NEW)
    assert out.where("k is null and is_current").count() == 2 and out.count() == 6
    assert temporal.scd3_apply(dim(spark), stage, "k", "tier").count() == 4
    target = spark.createDataFrame([(None, "t"), (1, "t")], "k int, name string")
    merged = loading.upsert(target, spark.createDataFrame([(None, "s"), (None, "s"), (1, "s")], "k int, name string"), ["k"])
    assert rows(merged) == sorted([(None, "t"), (None, "s"), (None, "s"), (1, "s")], key=repr)


def test_rows_without_a_key_are_spread(spark):
    """Keys laid out for the join: no partition holds most of the rows whose key is missing."""
    from dwops.plans.keyed import once_per_key

    source = spark.range(8000).select(F.lit(None).cast("int").alias("k"), F.col("id").alias("v"))
    sizes = once_per_key(source, ["k"], "s").groupBy(F.spark_partition_id()).count()
    assert sizes.agg(F.max("count")).first()[0] < 4000


# --- pairs of overlapping intervals ----------------------------------------

def brute(data):
    out = []
    for i, (k, a, s, e) in enumerate(data):
        for k2, b, s2, e2 in data:
            if None not in (k, a, s, e, k2, b, s2, e2) and k == k2 and a < b and s < e2 and s2 < e:
                out.append((k, a, b, max(s, s2), min(e, e2)))
    return sorted(out, key=repr)


def intervals(n, seed, hot):
    rnd = random.Random(seed)
    t0, out = dt.datetime(1969, 12, 1), []
    for i in range(n):
        start = t0 + dt.timedelta(minutes=rnd.randrange(60 * 24 * 60))
        minutes = rnd.choice([0, 1, 5, 60, 60, 61, 1440, 10_000, 200_000])
        out.append(("hot" if rnd.random() < hot else rnd.choice(["a", "b"]), i, start, start + dt.timedelta(minutes=minutes)))
    return out


SCHEMA = "k string, id int, s timestamp_ntz, e timestamp_ntz"


@pytest.mark.parametrize("seed,hot", [(1, 0.3), (2, 0.95), (3, 0.0)])
def test_pairs_against_brute_force(spark, seed, hot):
    data = intervals(160, seed, hot)
    data += [(None, 900, data[0][2], data[0][3]), ("hot", None, data[0][2], data[0][3]), ("hot", 901, None, data[0][3]), ("hot", 902, data[0][2], None)]
    got = temporal.overlap_pairs(spark.createDataFrame(data, SCHEMA), "k", "s", "e", "id")
    assert rows(got, "k", "first_id", "second_id", "overlap_start", "overlap_end") == brute(data)


def test_pairs_of_one_key_are_looked_for_by_bucket(spark):
    """20,000 short bookings of one key, one after the other, and one that covers them all."""
    t0 = F.lit("2024-01-01").cast("timestamp_ntz")
    chain = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").cast("int").alias("id"),
                                       (t0 + F.make_dt_interval(mins=F.col("id").cast("int") * 10)).alias("s"), (t0 + F.make_dt_interval(mins=F.col("id").cast("int") * 10 + 10)).alias("e"))
    cover = spark.createDataFrame([("hot", -1, dt.datetime(2024, 1, 1), dt.datetime(2025, 1, 1))], SCHEMA)
    got = temporal.overlap_pairs(chain.unionByName(cover), "k", "s", "e", "id")
    assert got.agg(F.count(F.lit(1)), F.min("first_id"), F.max("first_id")).first() == (20_000, -1, -1)
    assert temporal.overlap_pairs(chain.limit(0), "k", "s", "e", "id").count() == 0


def test_sums_keep_what_the_caller_does_not_round(spark):
    from dwops.operators import relational as rel, windows as win

    df = spark.createDataFrame([(day("2024-01-01"), 0.004, 1), (day("2024-01-01"), 0.004, 2)], "d date, v double, k int")
    assert rel.daily_summary(df, "d", "v", "k").first()["revenue"] == 0.008
    assert rel.daily_summary(df, "d", "v", "k", 3).first()["avg_order_value"] == 0.004
    assert rel.lifetime_value(df.select("k"), df, ["k"], "v").first()["lifetime_value"] == 0.004
    assert {r["total"] for r in win.period_total(df, F.year("d"), "v", "total").collect()} == {0.008}
    summary = loading.build_summary(df, ["d"], "v")
    both = loading.refresh_summary(summary, summary).first()
    assert (both["cnt"], both["total_amount"], both["min_amount"]) == (4, 0.016, 0.004)
    exact = loading.build_summary(df.withColumn("v", F.col("v").cast("decimal(10,4)")), ["d"], "v")
    assert str(loading.refresh_summary(exact, exact).first()["total_amount"]) == "0.0160"
    assert loading.periodic_snapshot(df, "d", "d", "v").first()["balance"] == 0.008
