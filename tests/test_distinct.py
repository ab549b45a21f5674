"""Mergeable distinct counts against sets."""

import random

import pytest
from pyspark.sql import functions as F

from dwops.operators import distinct
from tests.test_rules import rows

SCHEMA = "g string, h int, v long"


def some_rows(n, seed):
    rnd = random.Random(seed)
    edge = [0, 1, 63, 64, -1, -64, -65, 2**63 - 1, -(2**63), None]
    return [(rnd.choice(["a", "b", None]), rnd.choice([1, 2]), rnd.choice([*edge, rnd.randrange(-300, 300)])) for _ in range(n)]


def sets(data, key):
    out = {}
    for g, h, v in data:
        out.setdefault(key(g, h), set()).update([] if v is None else [v])
    return out


def test_merged_sets_equal_a_rebuild(spark):
    old, new = some_rows(300, 1), some_rows(200, 2)
    bits = distinct.merge_bits(*[distinct.id_bits(spark.createDataFrame(part, SCHEMA), ["g", "h"], "v") for part in (old, new + old[:50])])
    want = sets(old + new, lambda g, h: (g, h))
    assert {(r["g"], r["h"]): r["n"] for r in distinct.count_bits(bits, "n").collect()} == {k: len(s) for k, s in want.items() if s}
    coarse = distinct.count_bits(distinct.roll_up_bits(bits, [F.coalesce("g", F.lit("none")).alias("g")]), "n")
    assert {r["g"]: r["n"] for r in coarse.collect()} == {k: len(s) for k, s in sets(old + new, lambda g, h: g or "none").items() if s}
    everything = distinct.count_bits(distinct.roll_up_bits(bits, []), "n")
    assert everything.first()["n"] == len({v for _, _, v in old + new} - {None})


def test_shared_values(spark):
    old, new = some_rows(120, 3), some_rows(90, 4)
    got = distinct.shared_bits(*[distinct.id_bits(spark.createDataFrame(part, SCHEMA), ["h"], "v") for part in (old, new)])
    a, b = sets(old, lambda g, h: h), sets(new, lambda g, h: h)
    assert {r["h"]: r["shared_count"] for r in got.collect()} == {h: len(a[h] & b[h]) for h in a}


def test_groups_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 1, 7)], SCHEMA)
    bits = distinct.id_bits(df, ["g"], "v")
    summary = df.groupBy("g").agg(F.count(F.lit(1)).alias("cnt"))
    assert rows(distinct.with_distinct(summary, bits, "n")) == [("a", 1, 0), ("b", 1, 1)]
    assert distinct.count_bits(distinct.id_bits(df.limit(0), ["g"], "v")).count() == 0
    with pytest.raises(TypeError, match="only integers"):
        distinct.id_bits(df, [], "g")


def test_a_hot_group_is_combined_before_the_shuffle(spark):
    df = spark.range(100_000).select(F.lit("hot").alias("g"), (F.col("id") % 6400).alias("v"))
    bits = distinct.id_bits(df, ["g"], "v")
    assert bits.count() == 100 and distinct.count_bits(bits, "n").first()["n"] == 6400
    plan = bits._jdf.queryExecution().executedPlan().toString()
    assert "partial_bit_or" in plan and "SortAggregate" not in plan and "ObjectHashAggregate" not in plan
