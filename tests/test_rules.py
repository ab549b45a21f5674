"""Edge rules on literal rows."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Window, functions as F

from dwops import session
from dwops.functions import values as v
from dwops.operators import discovery, graph, loading, quality, relational as rel, search, temporal, windows as win
from dwops.plans import keyed, ordered
from dwops.plans.frontier import expand
from dwops.sources import files, tables
from dwops.session import fresh_path
from dwops.streaming import jobs


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def day(text):
    return dt.date.fromisoformat(text)


# --- joins -----------------------------------------------------------------

@pytest.mark.parametrize("right,want", [
    ([1, 2], [(3,)]), ([1, None], []), ([], [(None,), (1,), (3,)]), ([None], []),
])
def test_not_in_null_rules(spark, right, want):
    left = spark.createDataFrame([(1,), (3,), (None,)], "a int")
    other = spark.createDataFrame([(x,) for x in right], "b int")
    assert rows(rel.not_in(left, "a", other, "b")) == sorted(want, key=repr)


def test_null_safe_join(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, a int")
    b = spark.createDataFrame([(None, 10), ("y", 20)], "k string, b int")
    assert rows(rel.null_safe_join(a, b, ["k"])) == [(None, 1, 10)]


def test_growth_needs_the_month_before(spark):
    df = spark.createDataFrame([("a", day("2024-01-01"), 10), ("a", day("2024-02-01"), 15), ("a", day("2024-04-01"), 5)], "k string, month date, total int")
    out = rows(rel.period_over_period(df, ["k"], "month", "total"), "month", "growth", "growth_pct")
    assert out == [(day("2024-01-01"), 10.0, None), (day("2024-02-01"), 5.0, 50.0), (day("2024-04-01"), 5.0, None)]


def test_hinted_join_counts_before_broadcast(spark, monkeypatch):
    a, b = spark.range(20).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(rel.hinted_join(a, b, "k", "broadcast"))
    monkeypatch.setattr(rel, "BROADCAST_ROWS", 5)
    assert "broadcast" not in plan(rel.hinted_join(a, b, "k", "broadcast"))
    assert rel.hinted_join(a, b, "k", "merge").count() == 10
    with pytest.raises(ValueError):
        rel.hinted_join(a, b, "k", "nested")


def test_above_group_avg_keeps_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    assert rows(rel.above_group_avg(df, ["k"], "v")) == [(None, 3.0, 2.0)]


def test_asof_boundary_day(spark):
    dim = spark.createDataFrame([(1, "old", day("2024-01-01"), day("2024-02-01")), (1, "new", day("2024-02-01"), None)],
                                "k int, name string, valid_from date, valid_to date")
    fact = spark.createDataFrame([(1, day(d)) for d in ("2023-12-31", "2024-01-31", "2024-02-01", "2030-01-01")], "k int, d date")
    out = temporal.asof_join(fact, dim, "k", "d", "valid_from", "valid_to", ["name"])
    assert rows(out, "d", "name") == [(day("2024-01-31"), "old"), (day("2024-02-01"), "new"), (day("2030-01-01"), "new")]
    assert rows(temporal.scd2_at(dim, "2024-02-01"), "name") == [("new",)]


def test_asof_and_history_to_the_instant(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    log = spark.createDataFrame([(1, "a", at(8), 1), (1, "b", at(15), 2), (1, "a", at(20), 3)], "k int, name string, ts timestamp_ntz, n int")
    dim = temporal.scd2_from_changes(log, "k", "ts", ["name"], "n")
    assert rows(dim, "name", "valid_from") == [("a", at(20)), ("a", at(8)), ("b", at(15))]
    fact = spark.createDataFrame([(1, at(10)), (1, at(15)), (1, at(23))], "k int, t timestamp_ntz")
    got = temporal.asof_join(fact, dim, "k", "t", "valid_from", "valid_to", ["name"])
    assert rows(got, "t", "name") == [(at(10), "a"), (at(15), "b"), (at(23), "a")]


def test_asof_cuts_one_key_and_time(spark):
    dim = spark.createDataFrame([(1, "a", day("2024-01-01"), None)], "k int, name string, valid_from date, valid_to date")
    fact = spark.range(500).select(F.lit(1).alias("k"), F.lit("2024-01-02").cast("date").alias("d"), "id")
    spark.conf.set("spark.dwops.chunkRows", "100")
    try:
        got = temporal.asof_join(fact, dim, "k", "d", "valid_from", "valid_to", ["name"])
        assert got.where("name = 'a'").count() == 500
    finally:
        spark.conf.unset("spark.dwops.chunkRows")


def test_overlap_with_empty_intervals(spark):
    df = spark.createDataFrame([(1, 0, 10, "long"), (1, 5, 5, "empty"), (1, 5, 5, "twin"), (1, 10, 10, "end")], "k int, a int, b int, n string")
    assert rows(temporal.overlap_conflicts(df, "k", "a", "b"), "n", "conflicts") == [("empty", 1), ("long", 2), ("twin", 1)]


def test_discrete_percentile_position_is_decimal(spark):
    df = spark.range(1, 101).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("v"))
    assert rows(rel.percentiles(df, ["k"], "v", {}, {"p": 0.55}), "p") == [(55.0,)]


def test_means_keep_the_digits_asked_for(spark):
    df = spark.createDataFrame([("a", 0.0041), ("b", 0.0049)], "k string, v double")
    assert rows(rel.slowest_groups(df, ["k"], "v"), "k", "mean_time") == [("a", 0.0041), ("b", 0.0049)]


def test_upsert_refuses_a_key_staged_twice(spark):
    target = spark.createDataFrame([(1, "a")], "k int, name string")
    source = spark.createDataFrame([(1, "x"), (1, "y")], "k int, name string")
    with pytest.raises(Exception, match="more than once"):
        loading.upsert(target, source, ["k"]).collect()


def test_surrogate_key_once_per_member(spark):
    dim = spark.createDataFrame([(10, "a")], "sk int, nk string")
    stage = spark.createDataFrame([("b", 2), ("b", 1), ("c", 3)], "nk string, x int")
    assert rows(loading.assign_keys(dim, stage, "nk", "sk")) == [("b", 1, 11), ("c", 3, 12)]


def test_null_text_is_not_the_empty_text(spark):
    old, new = (spark.createDataFrame([(1, v), (2, None)], "k int, s string") for v in (None, ""))
    assert rows(loading.changed_rows(old, new, "k", "s"), "k", "status") == [(1, "changed")]


def test_split_by_type_finds_all_types(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "t string, v int")
    got = loading.split_by_type(df, "t", fresh_path(spark, "typed"))
    assert {k: rows(part) for k, part in got.items()} == {"a": [(1,)], "b": [(2,)], None: [(3,)]}


def test_shared_column_names_are_all_proposed(spark):
    found = discovery.propose_joins({"a": ["x_id", "y_id"], "b": ["id"]})
    assert [(p[1], p[3]) for p in found if p[4] == "COMMON_COLUMN"] == [("x_id", "id"), ("y_id", "id")]


def test_interval_sums_of_doubles_in_large_groups(spark):
    values = [(1, dt.datetime(2024, 1, 1) + dt.timedelta(days=20 * i), v) for i, v in enumerate([1e17, 0.1, 0.2])]
    df = spark.createDataFrame([*values, (1, None, 5.0)], "k int, ts timestamp_ntz, v double")
    total = {"s": F.col("v")}
    small = win.moving_interval(df, "ts", "7 days", "0 days", total, ["k"])
    large = win.moving_interval(df, "ts", "7 days", "0 days", total, ["k"], rows=1)
    assert rows(small, "v", "s") == rows(large, "v", "s") == [(0.1, 0.1), (0.2, 0.2), (1e17, 1e17), (5.0, 5.0)]
    exact = df.withColumn("v", F.lit(1).cast("decimal(10,2)"))
    assert win.moving_interval(exact, "ts", "7 days", "0 days", total, ["k"], rows=1).schema["s"] == \
        win.moving_interval(exact, "ts", "7 days", "0 days", total, ["k"]).schema["s"]


@pytest.mark.parametrize("frame", ["rows", "range"])
def test_running_type_does_not_depend_on_size(spark, frame):
    df = spark.range(30).select(F.lit(1).alias("k"), "id", F.lit(1).cast("decimal(21,2)").alias("v"))
    small, large = (win.running(df, F.col("v"), ["id"], ["k"], frame, rows=n) for n in (None, 7))
    assert small.schema["running_total"].dataType == large.schema["running_total"].dataType
    assert rows(small, "id", "running_total") == rows(large, "id", "running_total")


def test_last_value_by_descending_text_in_cut_groups(spark):
    df = spark.range(20).select(F.lit(1).alias("k"), F.format_string("%02d", "id").alias("o"), F.when(F.col("id") % 6 == 5, F.col("id")).alias("v"))
    small, large = (ordered.scan_groups(df, ["k"], ["-o"], last={"l": F.col("v")}, rows=n) for n in (None, 4))
    assert rows(small, "o", "l") == rows(large, "o", "l")


def test_lineage_runs_to_the_end(spark):
    edges = {"x": spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}") for i in range(15)], "src string, dst string")}
    start = spark.createDataFrame([("00",)], "node string")
    assert graph.trace_lineage(edges, start, "down").count() == 16


def test_lineage_keeps_no_edges_sorted_or_sent(spark, monkeypatch):
    edges = {"x": spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("c", None)], "src string, dst string"), "w": spark.createDataFrame([("a", "c"), ("b", "a"), ("b", None)], "src string, dst string")}
    start, plans = spark.createDataFrame([("a",)], "node string"), []

    def watched(seeds, step, *rest, **options):
        def seen(*args):
            plans.append(step(*args))
            return plans[-1]
        return expand(seeds, seen, *rest, **options)

    monkeypatch.setattr(graph, "expand", watched)
    monkeypatch.setattr(graph, "SENT_NODES", 0)
    # The first source by name counts; a missing end is one node.
    assert rows(graph.trace_lineage(edges, start, "down")) == sorted([("a", 0, None), ("b", 1, "x"), ("c", 1, "w"), (None, 2, "w")], key=repr)
    text = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert text and not any(word in t for t in text for word in ("SortAggregate", "Broadcast", "LeftAnti"))


def test_tag_terms_with_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "two")], "id int, body string")
    terms = spark.createDataFrame([("two",)], "term string")
    few, many = (rows(search.tag_terms(docs, "id", "body", terms, "term", few=n), "id", "term") for n in (10, 0))
    assert few == many and len(few) == 3


def test_asof_respects_a_closed_end(spark):
    dim = spark.createDataFrame([(1, "a", day("2024-01-01"), day("2024-01-10"))], "k int, name string, valid_from date, valid_to date")
    fact = spark.createDataFrame([(1, day("2024-01-09")), (1, day("2024-01-10"))], "k int, d date")
    assert rows(temporal.asof_join(fact, dim, "k", "d", "valid_from", "valid_to", ["name"]), "d") == [(day("2024-01-09"),)]


@pytest.mark.parametrize("chunk", ["7", "5000000"])
def test_overlap_conflicts_brute_force(spark, chunk):
    rnd = random.Random(3)
    data = []
    for i in range(120):
        start = day("2024-01-01") + dt.timedelta(days=rnd.randrange(60))
        data.append((i, rnd.choice([1, 1, 2]), start, start + dt.timedelta(days=rnd.randrange(1, 9))))
    want = []
    for i, k, s, e in data:
        n = sum(1 for j, k2, s2, e2 in data if j != i and k2 == k and s2 < e and s < e2)
        if n:
            want.append((i, n))
    df = spark.createDataFrame(data, "id int, k int, s date, e date")
    spark.conf.set("spark.dwops.chunkRows", chunk)
    try:
        assert rows(temporal.overlap_conflicts(df, "k", "s", "e"), "id", "conflicts") == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.dwops.chunkRows")


# --- windows ---------------------------------------------------------------

def test_rank_all_ties(spark):
    data = [("n", 7, i) for i in range(3)] + [("n", 2, 9), ("n", None, 4), ("s", 5, 1), ("s", 5, 2), ("s", 8, 0)]
    df = spark.createDataFrame(data, "g string, score int, tag int")
    got = rows(win.rank_all(df, ["g"], "score", ["tag"]), "g", "score", "tag", "rank", "dense_rank", "row_num")
    assert got == sorted([("n", None, 4, 1, 1, 1), ("n", 2, 9, 2, 2, 2), ("n", 7, 0, 3, 3, 3), ("n", 7, 1, 3, 3, 4), ("n", 7, 2, 3, 3, 5),
                          ("s", 5, 1, 1, 1, 1), ("s", 5, 2, 1, 1, 2), ("s", 8, 0, 3, 2, 3)], key=repr)


def test_sessions_exact_gap_stays(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda *m: [(1, t0 + dt.timedelta(minutes=x), i) for i, x in enumerate(m)]
    df = spark.createDataFrame(at(0, 30, 61, 62), "u int, ts timestamp_ntz, id int")
    assert rows(win.sessionize(df, "u", "ts", ["id"]), "id", "new_session", "session_id") == [(0, 0, 0), (1, 0, 0), (2, 1, 1), (3, 0, 1)]


@pytest.mark.parametrize("limit", [3, 10_000])
@pytest.mark.parametrize("before,after", [("7 days", "0 days"), ("2 days", "2 days"), ("30 minutes", "0 minutes")])
def test_moving_interval(spark, tiny, limit, before, after):
    events = spark.read.parquet(f"{tiny}/events.parquet").select("event_id", F.expr("case when user_id < 50 then 1 else user_id end").alias("user_id"), "ts", "value", "event_type")
    value = F.when(F.col("event_type") != "error", v.money("value"))
    got = win.moving_interval(events, "ts", before, after, {"s": value, "n": F.lit(1).cast("long")}, ["user_id"], rows=limit)
    events.createOrReplaceTempView("moving_events")
    want = spark.sql(f"""select *, sum(case when event_type <> 'error' then cast(value as decimal(18,2)) end) over w as s, count(*) over w as n from moving_events
        window w as (partition by user_id order by ts range between interval {before} preceding and interval {after} following)""")
    cols = ["event_id", "s", "n"]
    assert rows(got, *cols) == rows(want, *cols)


@pytest.mark.parametrize("limit", [20, None])
def test_running_range_gives_peers_one_total(spark, tiny, limit):
    orders = spark.read.parquet(f"{tiny}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus")
    got = win.running(orders, v.money("o_totalprice"), ["o_orderpriority"], ["o_orderstatus"], "range", rows=limit)
    w = Window.partitionBy("o_orderstatus").orderBy("o_orderpriority")
    want = orders.withColumn("running_total", F.sum(v.money("o_totalprice")).over(w))
    assert rows(got) == rows(want, *got.columns)


def test_lag_over_filled_months(spark):
    df = spark.createDataFrame([(day("2023-01-01"), 1), (day("2024-01-01"), 5), (day("2024-02-01"), 6)], "month date, revenue int")
    out = {r["month"]: r["previous_value"] for r in win.yoy_lag(df, "month", "revenue").collect()}
    assert out[day("2024-01-01")] == 1 and out[day("2024-02-01")] is None and len(out) == 14


def test_nth_value_of_short_group(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 7, 1)], "k int, v int, o int")
    assert rows(win.nth_value_by(df, "v", 2, ["o"], ["k"], "second"), "k", "v", "second") == [(1, 5, 6), (1, 6, 6), (2, 7, None)]


def test_percentiles(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 2, 10)] + [("b", 3.0), ("b", None)], "k string, v double")
    got = rel.percentiles(df, ["k"], "v", {"p50": 0.5, "p90": 0.9}, {"d0": 0.0, "d50": 0.5, "d100": 1.0})
    want = df.groupBy("k").agg(F.expr("percentile_cont(0.5) within group (order by v)").alias("p50"), F.expr("percentile_cont(0.9) within group (order by v)").alias("p90"),
                               *[F.expr(f"percentile_disc({p}) within group (order by v)").alias(n) for n, p in (("d0", 0.0), ("d50", 0.5), ("d100", 1.0))])
    for g, w in zip(rows(got), rows(want)):
        assert g[0] == w[0] and g[1:] == pytest.approx(w[1:])


# --- hierarchies -----------------------------------------------------------

def test_walk_cuts_cycles(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (1, 3, "a")], "id int, parent int, name string")
    out = rows(graph.walk_hierarchy(df, "id", "parent", "name"), "id", "level", "name_path")
    assert out == [(1, 1, "a"), (2, 2, "a > b"), (3, 3, "a > b > c")]


def test_bom_adds_paths_and_cuts_cycles(spark):
    edges = spark.createDataFrame([("p", "a", 2), ("p", "b", 1), ("a", "c", 3), ("b", "c", 5), ("c", "a", 1)], "part_id string, component_id string, quantity int")
    # a: 2 + 1*5 through b, c; b: 1; c: 2*3 + 5
    assert rows(graph.explode_bom(edges, "p")) == [("a", 7, 3), ("b", 1, 1), ("c", 11, 2)]


def test_lineage_stops_at_limit_and_marks_source(spark):
    edges = {"x": spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), "y": spark.createDataFrame([("c", "d"), ("d", "b")], "src string, dst string")}
    start = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.trace_lineage(edges, start, "down")) == [("a", 0, None), ("b", 1, "x"), ("c", 2, "x"), ("d", 3, "y")]
    assert rows(graph.trace_lineage(edges, start, "down", 1), "node") == [("a",), ("b",)]
    assert rows(graph.trace_lineage(edges, spark.createDataFrame([("c",)], "node string"), "up"), "node") == [("a",), ("b",), ("c",), ("d",)]


def test_expand_refuses_endless_growth(spark):
    with pytest.raises(ValueError):
        expand(spark.range(1), lambda f, *_: f, 3, stop_quietly=False)


def test_check_levels_reports_unreachable(spark):
    df = spark.createDataFrame([(1, None, 1), (2, 1, 2), (3, 99, 2), (4, 2, 9)], "id int, parent int, level long")
    assert rows(graph.check_levels(df, "id", "parent", "level")) == [(3, 2, None), (4, 9, 3)]


# --- loading ---------------------------------------------------------------

def test_upsert_null_overwrites(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, n int")
    source = spark.createDataFrame([(2, None), (3, "c")], "k int, name string")
    assert rows(loading.upsert(target, source, ["k"])) == [(1, "a", 1), (2, None, 2), (3, "c", None)]


def test_scd2_apply_twice_is_stable(spark):
    dim = temporal.first_versions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string"), "2024-01-01")
    stage = spark.createDataFrame([(2, "B"), (3, "c")], "k int, name string")
    once = temporal.scd2_apply(dim, stage, "k", ["name"], "2024-02-01")
    assert rows(once, "k", "name", "valid_to", "is_current") == [
        (1, "a", None, True), (2, "B", None, True), (2, "b", day("2024-02-01"), False), (3, "c", None, True)]
    again = temporal.scd2_apply(once, stage, "k", ["name"], "2024-03-01")
    assert rows(again) == rows(once)
    assert quality.check_unique_where(again, ["k"], F.col("is_current")).isEmpty()


def test_version_table_closes_missing(spark):
    history = temporal.first_versions(spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string"), "2024-01-01")
    out = temporal.version_table(history, spark.createDataFrame([(1, "a")], "k int, name string"), "k", "2024-02-01")
    assert rows(out, "k", "is_current") == [(1, True), (2, False)]


def test_scd3_keeps_one_level(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, seg string")
    one = temporal.scd3_apply(dim, spark.createDataFrame([(1, "A"), (2, "b"), (3, "c")], "k int, seg string"), "k", "seg")
    assert rows(one) == [(1, "A", "a"), (2, "b", None), (3, "c", None)]
    two = temporal.scd3_apply(one, spark.createDataFrame([(1, "X")], "k int, seg string"), "k", "seg")
    assert rows(two) == [(1, "X", "A"), (2, "b", None), (3, "c", None)]


def test_null_high_water_mark_loads_nothing(spark):
    source = spark.createDataFrame([(1, dt.datetime(2024, 1, 1))], "k int, ts timestamp_ntz")
    control = spark.createDataFrame([("other", dt.datetime(2023, 1, 1))], "table_name string, load_date timestamp_ntz")
    assert loading.incremental(source, control, "mine", "ts").isEmpty()
    assert loading.incremental(source, control, "other", "ts").count() == 1


def test_next_mark_keeps_old_mark(spark):
    control = spark.createDataFrame([("t", dt.datetime(2024, 1, 1))], "table_name string, load_date timestamp_ntz")
    none = spark.createDataFrame([], "ts timestamp_ntz")
    assert rows(loading.next_mark(none, control, "t", "ts")) == [("t", dt.datetime(2024, 1, 1), 0)]


def test_audit_ignores_equal_rows_and_sees_nulls(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, name string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "k int, name string")
    assert rows(loading.audit_diff(old, new, "k"), "record_id", "action") == [(2, "UPDATE"), (3, "DELETE"), (4, "INSERT")]


# --- scans and sinks -------------------------------------------------------

def test_preview_of_exactly_limit_rows(spark):
    assert {r["truncated"] for r in tables.preview(spark.range(5), 5).collect()} == {True}
    assert {r["truncated"] for r in tables.preview(spark.range(4), 5).collect()} == {False}


def test_csv_keeps_null_apart_from_empty(spark):
    df = spark.createDataFrame([(1, None, "x, y"), (2, "", 'say "hi"'), (3, "\\", "two\nlines")], "k int, a string, b string")
    path = files.write_csv(df, fresh_path(spark, "csv"))
    assert rows(files.read_csv(spark, path, df, multi_line=True)) == rows(df)


def test_pruned_scan_reads_only_wanted_folders(spark):
    df = spark.range(100).withColumn("part", (F.col("id") % 10).cast("int"))
    path = files.write_partitioned(df, fresh_path(spark, "parts"), "part")
    scan = files.scan_partitions(spark, path, "part", 3, 5)
    assert "PartitionFilters: [isnotnull(part" in scan._jdf.queryExecution().executedPlan().toString()
    assert scan.count() == 20 and len(scan.inputFiles()) <= 2 * 10


def test_list_bucket_default(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert rows(df.select(files.list_bucket("c", {"g": ["a"]}))) == [("default",), ("default",), ("g",)]


def test_shared_folder_is_required_on_a_cluster():
    context = SimpleNamespace(master="yarn", getCheckpointDir=lambda: None)
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        session.shared_root(fake)


def test_filter_and_columns_reach_the_scan(spark, tiny):
    df = tables.load(spark, tiny, "orders", "o_orderkey", "o_orderdate")
    plan = tables.between_dates(df, "o_orderdate", "1996-01-01", "1996-02-01").select("o_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan


def test_top_per_key_limits_before_the_shuffle(spark, tiny):
    orders = tables.load(spark, tiny, "orders")
    plan = rel.top_per_key(orders, ["o_custkey"], ["-o_orderdate", "o_orderkey"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


# --- quality ---------------------------------------------------------------

def test_profile_of_empty_table(spark):
    out = rows(quality.profile(spark.createDataFrame([], "a int, b string")), "column", "total_rows", "distinct_count", "null_count", "null_pct", "min", "top_values")
    assert out == [("a", 0, 0, 0, 0.0, None, None), ("b", 0, 0, 0, 0.0, None, None)]


def test_profile_counts_nulls_and_skips_min_max(spark):
    df = spark.createDataFrame([("a", [1]), ("a", None), (None, [2])], "t string, l array<int>")
    out = {r["column"]: r for r in quality.profile(df).collect()}
    assert out["t"]["null_count"] == 1 and out["t"]["null_pct"] == 33.33 and out["t"]["top_values"] == "a:2" and out["t"]["min"] == "a"
    assert out["l"]["min"] is None and out["l"]["distinct_count"] == 2


def test_rule_with_null_passes(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "a int")
    assert rows(quality.check_rules(df, {"pos": F.col("a") > 0})) == [("pos", 3, 1)]


def test_unique_and_fk_exempt_null(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (1,), (2,)], "a int")
    assert rows(quality.check_unique(df, ["a"])) == [(1, 2)]
    assert rows(quality.check_fk(df, "a", spark.createDataFrame([(1,)], "k int"), "k")) == [(2,)]


def test_find_fds(spark):
    df = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (3, "y", 1), (None, "y", None)], "a int, b string, c int")
    holds = {(r["determinant"], r["dependent"]) for r in quality.find_fds(df, ["a", "b", "c"]).where("holds").collect()}
    assert holds == {("a", "b"), ("a", "c")}


def test_find_fds_bounds_cells_of_a_task(spark, monkeypatch):
    df = spark.range(0, 200, 1, 1).select("id", (F.col("id") % 5).alias("five"), F.nullif(F.col("id") % 10, F.lit(3)).alias("ten"))
    whole = rows(quality.find_fds(df, df.columns), "determinant", "dependent", "singles", "pairs")
    monkeypatch.setattr(keyed, "CELLS_PER_TASK", 100)
    found = quality.find_fds(df, df.columns)
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found, "determinant", "dependent", "singles", "pairs") == whole
    assert ("ten", "five", 10, 10) in whole and ("five", "ten", 5, 10) in whole


def test_first_members_without_grouping_single_rows(spark):
    df = spark.createDataFrame([(1, 5), (1, 3), (1, 3), (1, 9), (2, 7), (None, 2), (None, None), (3, 4), (3, 8)], "k int, v int")
    found = rel.first_members(df, ["k"], "v", 3)
    assert rows(found) == sorted([(1, 4, 3, 3, 5), (None, 2, *sorted_values(df, 2)), (3, 2, 4, 8, None)], key=repr)
    assert "max(CASE WHEN" not in found._jdf.queryExecution().toString()
    assert rows(rel.first_members(df, ["k"], "v", 1)) == sorted([(1, 4, 3), (None, 2, sorted_values(df, 1)[0]), (3, 2, 4)], key=repr)


def sorted_values(df, n):
    """What the plain order of a window gives for the missing key."""
    first = rel.top_per_key(df.where("k is null"), ["k"], ["v"], n).orderBy("_rn").collect()
    return (*[r["v"] for r in first], *[None] * (3 - n if n > 1 else 0))


def test_verify_join_without_matches(spark):
    a, b = spark.createDataFrame([(1,), (None,)], "a int"), spark.createDataFrame([(2,)], "b int")
    out = quality.verify_join(a, "a", b, "b", "a = b").first()
    assert (out["joined_rows"], out["left_orphans"], out["right_orphans"], out["match_pct"], out["verified"]) == (0, 2, 1, 0.0, False)


def test_pii_may_only_be_aggregated(spark):
    df = spark.createDataFrame([(1, "n")], "k int, name string")
    with pytest.raises(ValueError):
        rel.drop_pii(df, ["name"], select=["k", "name"])
    assert rel.drop_pii(df, ["name"]).columns == ["k"]


# --- discovery and search --------------------------------------------------

def test_join_proposals():
    found = discovery.propose_joins({"CUSTOMER": ["ID", "NAME"], "ORDERS": ["ORDER_ID", "CUSTOMER_ID", "NAME"], "LINES": ["ORDER_ID"]}, normalise=False)
    assert ("CUSTOMER", "ID", "ORDERS", "CUSTOMER_ID", "NAMING_CONVENTION", "MEDIUM") in found
    assert ("ORDERS", "ORDER_ID", "LINES", "ORDER_ID", "COMMON_COLUMN", "HIGH") in found
    assert ("CUSTOMER", "NAME", "ORDERS", "NAME", "COMMON_COLUMN", "MEDIUM") in found
    assert len(found) == 3


def test_inclusion_cardinality(spark):
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(1,), (1,), (3,), (None,)], "parent_id int")
    out = discovery.inclusion(child, "parent_id", parent, "id").first()
    assert (out["cardinality"], out["row_inclusion"], out["value_inclusion"]) == ("N:1", pytest.approx(2 / 3), 0.5)


@pytest.mark.parametrize("text,pattern,regex,want", [
    ("Insert INTO t", "into", False, True), ("abc", "", False, False), (None, "a", False, False), ("", "a", False, False),
    ("PKG_12", r"pkg_\d+", True, True), ("a.c", "a.c", False, True), ("abc", "a.c", False, False),
])
def test_match_rules(spark, text, pattern, regex, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(v.matches("t", pattern, regex)).first()[0] is want


def test_search_objects_needs_both_terms(spark):
    df = spark.createDataFrame([(1, "uses DIM_A\nand then COMMIT\nplain"), (2, "uses dim_a only"), (3, "dim_a; commit;")], "id int, body string")
    assert rows(search.search_objects(df, "id", "body", "dim_a", "commit")) == [(1, 2, "1,2"), (3, 1, "1")]
    assert rows(search.search_objects(df, "id", "body", "dim_a", None, limit=2), "id") == [(1,), (2,)]


def test_fetch_objects_caps_lines(spark):
    df = spark.createDataFrame([("A", "\n".join(str(i) for i in range(10)))], "id string, body string")
    assert search.fetch_objects(df, "id", "body", ["A"], limit_lines=3).count() == 3
    assert search.fetch_objects(df, "id", "body", ["A"]).count() == 10


@pytest.mark.parametrize("few", [0, 1000])
def test_tag_terms_both_ways(spark, few):
    docs = spark.createDataFrame([(1, "A Hundred\nredDish ox"), (2, None), (3, "no match"), (4, "x"), (5, "dred h")], "id int, body string")
    terms = spark.createDataFrame([("RED", 1), ("ox", 2), ("x", 3), ("hundred\nred", 4), ("", 5), ("h", 6), ("zebra", 7)], "term string, n int")
    got = rows(search.tag_terms(docs, "id", "body", terms, "term", few=few), "id", "term")
    texts = {1: "a hundred\nreddish ox", 3: "no match", 4: "x", 5: "dred h"}
    want = sorted(((i, t) for i, body in texts.items() for t, _ in [("RED", 1), ("ox", 2), ("x", 3), ("hundred\nred", 4), ("h", 6), ("zebra", 7)] if t.lower() in body), key=repr)
    assert got == want


def test_union_canonical_first_match_wins(spark):
    a = spark.createDataFrame([(1, "x", "y")], "` Code ` int, Name string, Title string")
    b = spark.createDataFrame([(2,)], "kode int")
    out = search.union_canonical({"a": a, "b": b}, {"code": "code", "kode": "code", "name": "label", "title": "label"})
    assert rows(out, "origin", "code", "label") == [("a", 1, "x"), ("b", 2, None)]


# --- functions -------------------------------------------------------------

def test_date_modes(spark):
    df = spark.createDataFrame([(day("2020-12-31"), day("2021-01-01"))], "a date, b date")
    assert df.select(v.date_diff("a", "b", "days"), v.date_diff("a", "b", "years")).first() == (1, 1)
    assert df.select(v.add_months(F.lit(day("2024-01-31")), 1)).first()[0] == day("2024-02-29")


def test_ratios_survive_zero(spark):
    df = spark.createDataFrame([(1, 0), (1, 4), (None, 4)], "a int, b int")
    assert [r[0] for r in df.select(v.pct("a", "b")).collect()] == [None, 25.0, None]


def test_as_bool(spark):
    df = spark.createDataFrame([("Y",), ("n",), ("1",), ("0",), ("maybe",), (None,)], "f string")
    assert [r[0] for r in df.select(v.as_bool("f")).collect()] == [True, False, True, False, None, None]
    assert spark.createDataFrame([(1,)], "f int").select(v.as_bool("f")).first()[0] is True


# --- streaming -------------------------------------------------------------

def test_incremental_stream_takes_new_files_once(spark, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    source, out, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    run = lambda: jobs.stream_incremental(jobs.file_stream(spark, source, events.schema, "ts"), "event_id", out, state)
    first, second = events.where("event_id < 600"), events.where("event_id >= 590")
    first.write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(out).count() == 600
    run()
    assert spark.read.parquet(out).count() == 600
    # Ten rows arrive again.
    second.write.mode("append").parquet(source)
    run()
    loaded = spark.read.parquet(out)
    assert loaded.count() == loaded.select("event_id").distinct().count() == events.count()
    # A row much older than all before is loaded too.
    late = events.limit(1).withColumns({"event_id": F.lit(-1).cast(events.schema["event_id"].dataType),
                                        "ts": F.lit("1970-01-02").cast(events.schema["ts"].dataType)})
    late.write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(out).where("event_id = -1").count() == 1


def test_summary_over_several_batches_equals_one(spark, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    source, out, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    events.repartition(4).write.parquet(source)
    stream = jobs.file_stream(spark, source, events.schema, "ts", files_per_batch=1)
    jobs.stream_summary(stream, "ts", "1 day", [F.count(F.lit(1)).alias("n"), v.exact_sum("value").alias("total")], out, state)
    got = rows(jobs.read_summary(spark, out).withColumn("d", F.col("window_start").cast("date")), "d", "n", "total")
    assert got == rows(events.groupBy(F.col("ts").cast("date").alias("d")).agg(F.count(F.lit(1)).alias("n"), v.exact_sum("value").alias("total")))


def test_upsert_stream_keeps_the_last_batch(spark):
    source, log, state = (fresh_path(spark, n) for n in ("in", "log", "state"))
    schema = "k int, name string, ts int"
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    run = lambda: jobs.stream_upsert(jobs.file_stream(spark, source, schema), ["k"], ["-ts"], log, state)
    spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "c", 1)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([(1, "z", 3)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert rows(jobs.upserted(target, log, ["k"])) == [(1, "z"), (2, "b"), (3, "c")]
    # An older change that comes later does not win when the order is given.
    spark.createDataFrame([(1, "old", 0)], schema).coalesce(1).write.mode("append").parquet(source)
    run()
    assert rows(jobs.upserted(target, log, ["k"], order=["-ts"])) == [(1, "z"), (2, "b"), (3, "c")]


def test_sessions_over_several_batches(spark, tiny):
    events = spark.read.parquet(f"{tiny}/events.parquet").withColumn("user_id", F.col("user_id") % 3)
    source, out, state = (fresh_path(spark, n) for n in ("in", "out", "state"))
    for first in range(1, 31, 6):
        events.where(F.dayofmonth("ts").between(first, first + 5)).coalesce(1).write.mode("append").parquet(source)
    stream = jobs.file_stream(spark, source, events.schema, "ts", files_per_batch=1)
    jobs.stream_sessions(stream, "user_id", "ts", "30 minutes", "1 hour", out, state)
    got = rows(spark.read.parquet(out), "user_id", "session_start", "session_end", "actions")
    numbered = win.sessionize(events, "user_id", "ts", ["event_id"])
    whole = numbered.groupBy("user_id", "session_id").agg(
        F.min("ts").alias("a"), (F.max("ts") + F.expr("interval 30 minutes")).alias("b"), F.count(F.lit(1)).alias("n"))
    ended = whole.where(F.col("b") <= events.agg(F.max("ts") - F.expr("interval 1 hour")).scalar())
    assert got == rows(ended, "user_id", "a", "b", "n") and len(got) < whole.count()


def test_tables_are_written_to_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x").startswith(f"{named}/dwops-")
    kept = session.stored(spark.range(3))
    assert all(named in f for f in kept.inputFiles()) and kept.count() == 3


def test_upsert_without_updates_keeps_matched_rows(spark):
    from dwops.operators.loading import upsert

    target = spark.createDataFrame([(1, "old")], "k int, v string")
    source = spark.createDataFrame([(1, "new"), (2, "added")], "k int, v string")
    assert sorted(map(tuple, upsert(target, source, ["k"], update={}).collect())) == [(1, "old"), (2, "added")]
