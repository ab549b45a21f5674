"""Aggregates of time intervals against the plain window."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dwops.operators import windows as win
from tests.test_rules import rows

SCHEMA = "id int, k string, ts timestamp_ntz, v double, d decimal(12,2), s string"
FRAMES = [("7 days", "0 days"), ("2 days", "2 days"), ("0 seconds", "0 seconds"), ("90 minutes", "180 minutes")]
NAMES = {"low": ("min", "v"), "high": ("max", "v"), "n": ("count", "v"), "every": ("count", None), "total": ("sum", "d"), "mean": ("avg", "d"),
         "first_word": ("min", "s"), "last_word": ("max", "s")}


def columns():
    return {n: (fn, F.col(c) if c else F.lit(1)) for n, (fn, c) in NAMES.items()}


def some_rows(n, seed, hot=0.8):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < hot else rnd.choice(["a", "b", None])
        at = None if rnd.random() < 0.03 else dt.datetime(1969, 12, 25) + dt.timedelta(minutes=30 * rnd.randrange(48 * 30))
        value = None if rnd.random() < 0.2 else float(rnd.randrange(-500, 500))
        out.append((i, key, at, value, None if value is None else Decimal(int(value)) / 4, rnd.choice(["x", "yy", "z", None])))
    return out


def plain(spark, df, before, after):
    df.createOrReplaceTempView("frames_in")
    return spark.sql(f"""select id, min(v) over w as low, max(v) over w as high, count(v) over w as n, count(1) over w as every, sum(d) over w as total,
        cast(sum(d) over w as double) / nullif(count(d) over w, 0) as mean, min(s) over w as first_word, max(s) over w as last_word
        from frames_in window w as (partition by k order by ts range between interval {before} preceding and interval {after} following)""")


@pytest.mark.parametrize("before,after", FRAMES)
@pytest.mark.parametrize("limit", [None, 40])
def test_frames_against_the_plain_window(spark, before, after, limit):
    df = spark.createDataFrame(some_rows(700, 5), SCHEMA)
    got = win.interval_frames(df, "ts", before, after, columns(), ["k"], rows=limit)
    assert got.columns == [*df.columns, *NAMES]
    want = plain(spark, df, before, after)
    assert rows(got, "id", *NAMES) == rows(want, "id", *NAMES)
    assert [got.schema[c].dataType for c in NAMES] == [want.schema[c].dataType for c in NAMES]


def test_one_large_group_whose_frames_hold_most_of_it(spark):
    """20,000 rows of one key in 30 days, frames of 20 days, in blocks cut to 1,500 rows."""
    df = spark.range(20_000).select(F.col("id").cast("int").alias("id"), F.lit("hot").alias("k"), F.expr("timestamp_seconds(130 * ((id * 7919) % 20011))").cast("timestamp_ntz").alias("ts"),
                                    ((F.col("id") * 37) % 1009).cast("double").alias("v"))
    got = win.interval_frames(df, "ts", "10 days", "10 days", {"low": ("min", F.col("v")), "high": ("max", F.col("v")), "n": ("count", F.col("v"))}, ["k"], rows=1500)
    data = sorted((r["ts"], r["id"], r["v"]) for r in df.collect())
    found = {r["id"]: (r["low"], r["high"], r["n"]) for r in got.collect()}
    span = dt.timedelta(days=10)
    for ts, i, _ in data[::1999]:
        inside = [v for t, _, v in data if ts - span <= t <= ts + span]
        assert found[i] == (min(inside), max(inside), len(inside))
    assert len(found) == 20_000


def test_sums_of_doubles_lose_no_digits(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "k", t0 + dt.timedelta(days=3 * i), v, None, None) for i, v in enumerate([1e17, 0.1, 0.2, -1e17, 0.3])], SCHEMA)
    got = win.interval_frames(df, "ts", "2 days", "0 days", {"total": ("sum", F.col("v"))}, ["k"])
    assert [r["total"] for r in got.orderBy("id").collect()] == [1e17, 0.1, 0.2, -1e17, 0.3]


def test_without_keys_empty_and_unknown(spark):
    df = spark.createDataFrame(some_rows(60, 6), SCHEMA)
    got = win.interval_frames(df, "ts", "1 days", "0 days", {"n": ("count", F.lit(1))})
    df.createOrReplaceTempView("frames_in")
    want = spark.sql("select id, count(1) over (order by ts range between interval 1 day preceding and current row) as n from frames_in")
    assert rows(got, "id", "n") == rows(want, "id", "n")
    assert win.interval_frames(df.limit(0), "ts", "1 days", "0 days", columns(), ["k"]).count() == 0
    with pytest.raises(ValueError, match="median"):
        win.interval_frames(df, "ts", "1 days", "0 days", {"m": ("median", F.col("v"))})
