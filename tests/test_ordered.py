"""Cut groups must give exactly what a plain window gives, ties and hot keys included."""

import pytest
from pyspark.sql import Window, functions as F

from dwops.plans.ordered import (
    chunked, ntile_from_number, previous_value, rank_values, row_frames, scan_groups, sort_columns,
)


@pytest.fixture(scope="module")
def hot(spark):
    """One customer holds a third of all orders; one group key is NULL."""
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    return orders.withColumn(
        "o_custkey",
        F.when(F.col("o_orderkey") < 500, F.lit(7)).when(F.col("o_custkey") != 9, F.col("o_custkey")),
    ).cache()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda df: sorted(map(repr, df.select(*cols).collect()))
    assert rows(a) == rows(b)


ORDERS = [["o_orderdate", "o_orderkey"], ["-o_orderdate", "o_orderkey"], ["-o_totalprice", "-o_orderkey"],
          ["o_orderpriority", "o_orderkey"]]


@pytest.mark.parametrize("keys", [["o_custkey"], [], ["o_custkey", "o_orderstatus"]])
@pytest.mark.parametrize("order", ORDERS)
def test_scan_groups(hot, keys, order):
    value = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)"))
    got = scan_groups(hot, keys, order, number="n", sums={"s": value}, last={"l": value}, rows=40)
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = hot.withColumns({"n": F.row_number().over(w).cast("long"), "s": F.sum(value).over(upto),
                            "l": F.last(value, ignorenulls=True).over(upto)})
    same(got, want)


@pytest.mark.parametrize("keys", [["o_custkey"], []])
def test_chunks_are_bounded(hot, keys):
    c = chunked(hot, keys, ["o_orderdate", "o_orderkey"], rows=40)
    sizes = [r["count"] for r in c.df.groupBy(*keys, "_chunk").count().collect()]
    assert max(sizes) <= 80 and c.df.count() == hot.count()
    assert chunked(hot, keys, ["o_orderkey"]).cut is None
    assert chunked(hot, keys, ["o_orderkey"], rows=1, bounded=True).cut is None


@pytest.mark.parametrize("keys", [["o_custkey"], []])
@pytest.mark.parametrize("before,after", [(1, 0), (2, 2), (6, 0), (0, 1), (30, 30)])
def test_row_frames(hot, keys, before, after):
    order = ["o_orderdate", "-o_orderkey"]
    make = {
        "s": lambda w: F.sum("o_orderkey").over(w.rowsBetween(-before, after)),
        "b": lambda w: F.lag("o_orderkey", before).over(w),
        "a": lambda w: F.lead("o_orderkey", after).over(w),
    }
    got = row_frames(hot, keys, order, before, after, make, rows=25)
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    same(got, hot.withColumns({n: f(w) for n, f in make.items()}))


@pytest.mark.parametrize("keys", [["o_custkey"], [], ["o_orderstatus"]])
@pytest.mark.parametrize("value", ["o_orderpriority", "-o_totalprice", "o_orderdate"])
def test_rank_values(hot, keys, value):
    got = rank_values(hot, keys, value, rows=20)
    w = Window.partitionBy(*keys).orderBy(*sort_columns([value]))
    want = hot.withColumns({
        "_rank": F.rank().over(w).cast("long"), "_dense": F.dense_rank().over(w).cast("long"),
        "_upto": F.count(F.lit(1)).over(w), "_total": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
    })
    same(got, want)


@pytest.mark.parametrize("total", [1, 3, 7, 20, 23])
def test_ntile(spark, total):
    df = spark.range(1, total + 1)
    w = Window.partitionBy().orderBy("id")
    got = df.select(
        *[ntile_from_number(F.col("id"), F.lit(total), n).alias(f"g{n}") for n in (1, 4, 10)],
        *[F.ntile(n).over(w).cast("long").alias(f"w{n}") for n in (1, 4, 10)],
    ).collect()
    assert all(r[f"g{n}"] == r[f"w{n}"] for r in got for n in (1, 4, 10))


def test_previous_value_uncut_equals_cut(hot):
    args = (hot, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"p": F.col("o_orderdate")})
    same(previous_value(*args), previous_value(*args, rows=30))
