"""Contained columns, references by name, search in source tables and headers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dwops.operators import discovery, search
from dwops.plans import keyed
from tests.test_rules import rows


def values(df):
    return {c: {r[0] for r in df.select(F.col(c).cast("string")).collect()} - {None} for c in df.columns}


def test_no_contained_pair_is_lost(spark):
    rnd = random.Random(8)
    # Sketches keep 4,096 hashes, so the large columns are really sampled.
    big = spark.range(30_000).select(F.col("id").alias("parent"), (F.col("id") * 3 % 10_007).alias("child"), (F.col("id") + 5).alias("shifted"), F.lit(None).cast("long").alias("nothing"))
    small = spark.createDataFrame([(rnd.randrange(50), rnd.choice(["a", "b", None]), str(rnd.randrange(20_000))) for _ in range(400)], "few int, letter string, digits string")
    tables = {"big": big, "small": small}
    every = {(t, c): v for t, df in tables.items() for c, v in values(df).items()}
    want = sorted((*a, *b) for a, x in every.items() for b, y in every.items() if a != b and x and x <= y)
    got = rows(discovery.contained_columns(tables), "table1", "column1", "table2", "column2")
    assert got == want and ("small", "digits", "big", "parent") in got and ("big", "shifted", "big", "parent") not in got


def test_one_missing_value_is_enough(spark):
    a = spark.range(20_000).select(F.col("id").alias("x"))
    b = spark.range(20_001).where("id <> 12345").select(F.col("id").alias("y"))
    assert rows(discovery.contained_columns({"a": a, "b": b})) == []
    assert rows(discovery.contained_columns({"a": a.limit(0), "b": b.limit(0)})) == []
    found = discovery.contained_columns({"a": a, "b": b.unionByName(spark.range(12345, 12346).select(F.col("id").alias("y")))}).first()
    assert (found["table1"], found["table2"], found["distinct1"], found["rows2"], found["unique2"]) == ("a", "b", 20_000, 20_001, True)


def test_values_are_not_spread_to_pairs(spark):
    df = spark.createDataFrame([(1, 1, "1"), (2, 1, "3"), (2, None, None)], "a int, b int, c string").withColumn("nothing", F.lit(None).cast("int"))
    pairs = [("t", x, "t", y, "GIVEN", "HIGH") for x, y in [("a", "b"), ("b", "a"), ("a", "a"), ("c", "a"), ("a", "nothing"), ("nothing", "nothing"), ("a", "b")]]
    measured = discovery.measure_pairs({"t": df}, pairs)
    assert not re.search(r"keys=\[pair#\d+, value#\d+\]", measured._jdf.queryExecution().toString())
    # Names, distinct values of both and common ones, rows, matched rows, unique; a pair of columns without values is left out.
    assert rows(measured.drop("table1", "table2", "rule", "confidence")) == sorted([
        ("a", "a", 2, 2, 2, 3, 3, 3, 3, False, False), ("a", "nothing", 2, 0, 0, 3, 0, 0, 0, False, False), ("b", "a", 1, 2, 1, 2, 3, 2, 1, False, False),
        ("c", "a", 2, 2, 1, 2, 3, 1, 1, True, False), *2 * [("a", "b", 2, 1, 1, 3, 2, 1, 2, False, False)]], key=repr)


def test_cells_of_a_task_are_bounded(spark, monkeypatch):
    df = spark.range(0, 300, 1, 2).select("id", (F.col("id") % 7).alias("seven"), F.repeat(F.lit("x"), 40).alias("long"))
    whole = rows(discovery.column_values({"t": df}, {("t", c) for c in df.columns}))
    monkeypatch.setattr(keyed, "CELLS_PER_TASK", 100)
    assert keyed.in_parts(df, 3).rdd.getNumPartitions() == 9 and keyed.in_parts(df, 3).count() == 300
    assert keyed.in_parts(df.limit(30), 3).rdd.getNumPartitions() == 1
    assert rows(discovery.column_values({"t": df}, {("t", c) for c in df.columns})) == whole and len(whole) == 308


def test_references_by_name():
    found = discovery.naming_hints({
        "CUSTOMERS": ["ID", "NAME"], "orders": ["order_id", "customer_id", "region_code", "note_no"], "T_REGION": ["T_REGION_CODE"], "notes": ["NOTE_NO"], "x": ["_id", "orders_id"],
    })
    assert sorted(found) == sorted((*f, "NAMING_CONVENTION", "MEDIUM") for f in [
        ("orders", "customer_id", "CUSTOMERS", "ID"), ("orders", "region_code", "T_REGION", "T_REGION_CODE"), ("orders", "note_no", "notes", "NOTE_NO")])
    # The table's own name is no reference, a column named like the other's key is.
    assert discovery.naming_hints({"DOC": ["DOC_ID"], "DOC_OLD": ["DOC_ID"]}) == [("DOC_OLD", "DOC_ID", "DOC", "DOC_ID", "NAMING_CONVENTION", "MEDIUM")]


SOURCE = "owner string, name string, type string, line int, text string"
LINES = [
    ("HR", "LOAD", "PACKAGE", 1, "create package  "), ("HR", "LOAD", "PACKAGE", 2, "select * from Staff where grade"), ("HR", "LOAD", "PACKAGE", 3, "end"),
    ("HR", "LOAD", "PACKAGE BODY", 1, "insert into staff"), ("HR", "LOAD", "PACKAGE BODY", 2, "update grade"), ("HR", "LOAD", "PACKAGE BODY", 3, None),
    ("OPS", "LOAD", "PACKAGE", 1, "staff only"), (None, "LOOSE", "VIEW", 1, "staff grade"),
]


def test_objects_by_owner_name_and_type(spark):
    source, keys = spark.createDataFrame(LINES, SOURCE), ["owner", "name", "type"]
    found = search.search_sources(source, keys, "line", "text", "STAFF", "grade")
    assert rows(found) == sorted([("HR", "LOAD", "PACKAGE", 1, [2]), ("HR", "LOAD", "PACKAGE BODY", 2, [1, 2]), (None, "LOOSE", "VIEW", 1, [1])], key=repr)
    whole = rows(search.source_of(source, found, keys, "line", "text"), "owner", "type", "line", "text")
    assert [r for r in whole if r[:2] == ("HR", "PACKAGE")] == [("HR", "PACKAGE", 1, "create package"), ("HR", "PACKAGE", 2, "select * from Staff where grade"), ("HR", "PACKAGE", 3, "end")]
    assert len(whole) == 7
    assert search.source_of(source, found, keys, "line", "text", 1).count() == 3
    only = search.search_sources(source, keys, "line", "text", "staff", None, within={"owner": ["HR", "OPS"], "type": ["PACKAGE"]}, limit=1)
    assert rows(only) == [("HR", "LOAD", "PACKAGE", 1, [2])]
    assert rows(search.search_sources(source, keys, "line", "text", "s.aff", "^update", regex=True, keep_lines=1), "type", "match_count", "matching_lines") == [("PACKAGE BODY", 2, [1])]
    with pytest.raises(ValueError, match="at least one"):
        search.search_sources(source, keys, "line", "text", None, "")


def test_headers_and_cells(spark):
    df = spark.createDataFrame([(1, "north", None), (2, "south", "rain")], "id int, region string, rain_mm string")
    found = rows(search.search_table(df, "weather", "id", "rain|north"), "matched_field", "row_key", "field", "context")
    assert found == sorted([("header", None, "rain_mm", "Header [2]: rain_mm"), ("cell", "1", "region", "id=1 | region=north"), ("cell", "2", "rain_mm", "id=2 | region=south | rain_mm=rain")], key=repr)
    assert rows(search.search_headers(df, "weather", "RAIN", regex=False), "field") == [("rain_mm",)]


def test_broadcast_is_bounded_in_bytes(spark, monkeypatch):
    from dwops.operators import relational as rel

    a = spark.range(5).withColumnRenamed("id", "k")
    wide = spark.range(5).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 1000).alias("text"), F.array(F.lit(1), F.lit(2)).alias("list"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(rel.hinted_join(a, wide, "k", "broadcast"))
    monkeypatch.setattr(rel, "BROADCAST_BYTES", 4000)
    assert "broadcast" not in plan(rel.hinted_join(a, wide, "k", "broadcast"))
    assert rel.hinted_join(a, wide.limit(0), "k", "broadcast").count() == 0


def test_strings_of_a_group_are_bounded(spark):
    from dwops.operators import relational as rel

    df = spark.createDataFrame([("g", "bb"), ("g", "a"), ("g", "a"), ("h", None)], "k string, v string")
    assert rows(rel.string_agg(df, ["k"], "v", most=7)) == [("g", "a, bb"), ("h", "")]
    with pytest.raises(ValueError, match="over 6 bytes"):
        rel.string_agg(df, ["k"], "v", most=6)


def test_a_cascade_is_followed_once(spark):
    from dwops.operators import quality

    nation = spark.createDataFrame([(1, "x")], "n int, name string")
    customer = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None)], "c int, n_of int")
    orders = spark.createDataFrame([(100, 10), (101, 10), (102, 12), (103, None)], "o int, c_of int")
    got = quality.delete_impact(nation, "nation", [("customer", customer, "n_of", "n"), ("orders", orders, "c_of", "c")])
    assert [tuple(r) for r in got.collect()] == [(1, "nation"), (2, "customer"), (2, "orders")]
    assert [tuple(r) for r in quality.delete_impact(nation.limit(0), "nation", [("customer", customer, "n_of", "n")]).collect()] == [(0, "nation"), (0, "customer")]
