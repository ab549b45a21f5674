"""Joins and lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dwops.functions import values as v
from dwops.operators import relational as rel, temporal, windows as win
from dwops.reports import inputs
from dwops.reports.registry import Tables, report
from dwops.reports.sql import CUST_VERSIONS, DAILY, ORDERS_NULL, REVENUE


@report("inner_join", "select o_orderkey, c_name, c_mktsegment, o_totalprice from orders join customer on o_custkey = c_custkey")
def inner_join(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.expr("o_custkey = c_custkey")).select("o_orderkey", "c_name", "c_mktsegment", "o_totalprice")


@report("left_join_default", """
select c_custkey, c_name, coalesce(n, 0) as done_orders from customer left join (
  select o_custkey, count(*) as n from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01' group by 1
) on c_custkey = o_custkey""")
def left_join_default(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderstatus = 'F' and o_orderdate >= timestamp_ntz '1995-01-01' and o_orderdate < timestamp_ntz '1996-01-01'")
    counts = done.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("done_orders"))
    return rel.left_default(t("customer", "c_custkey", "c_name"), counts, ["c_custkey"], {"done_orders": 0})


@report("star_join", f"""
select n_name, p_brand, cast(year(o_orderdate) as bigint) as order_year, cast(sum({REVENUE}) as double) as revenue, count(*) as line_count
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
join nation on c_nationkey = n_nationkey join part on l_partkey = p_partkey
where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1998-01-01' group by 1, 2, 3""")
def star_join(t: Tables) -> DataFrame:
    orders = t("orders", "o_orderkey", "o_custkey", "o_orderdate").where(
        "o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1998-01-01'")
    joined = rel.star_join(t("lineitem", "l_orderkey", "l_partkey", "l_extendedprice", "l_discount"), [
        (orders, F.expr("l_orderkey = o_orderkey")), (t("customer", "c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey")),
        (t("nation", "n_nationkey", "n_name"), F.expr("c_nationkey = n_nationkey")), (t("part", "p_partkey", "p_brand"), F.expr("l_partkey = p_partkey")),
    ])
    return joined.groupBy("n_name", "p_brand", v.year_of("o_orderdate").alias("order_year")).agg(
        v.revenue_total().cast("double").alias("revenue"), F.count(F.lit(1)).alias("line_count")
    )


@report("mom_growth", """
with m as (select o_orderpriority, cast(date_trunc('month', o_orderdate) as date) as month, sum(cast(o_totalprice as decimal(18,2))) as total_amount from orders group by 1, 2)
select a.o_orderpriority, a.month, cast(a.total_amount as double) as total_amount,
  cast(a.total_amount - coalesce(b.total_amount, 0) as double) as growth,
  round(100.0::double * cast(a.total_amount - coalesce(b.total_amount, 0) as double) / nullif(cast(b.total_amount as double), 0), 2) as growth_pct
from m a left join m b on a.o_orderpriority = b.o_orderpriority and a.month = b.month + interval 1 month""")
def mom_growth(t: Tables) -> DataFrame:
    monthly = t.orders.groupBy("o_orderpriority", v.month_of("o_orderdate").alias("month")).agg(v.money_total("o_totalprice").alias("total_amount"))
    grown = rel.period_over_period(monthly, ["o_orderpriority"], "month", "total_amount")
    return grown.withColumn("total_amount", F.col("total_amount").cast("double"))


YEAR_1995_F = "o_orderstatus = 'F' and o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'"


@report("semi_join", f"select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and {YEAR_1995_F})")
def semi_join(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderstatus = 'F' and o_orderdate >= timestamp_ntz '1995-01-01' and o_orderdate < timestamp_ntz '1996-01-01'")
    return rel.exists_in(t("customer", "c_custkey", "c_name"), done, F.expr("o_custkey = c_custkey"))


@report("anti_join", "select doc_id, source from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def anti_join(t: Tables) -> DataFrame:
    return rel.not_exists_in(t("documents", "doc_id", "source"), t("labels", "doc_id"), "doc_id")


@report("anti_left_null", "select c_custkey, c_name from customer left join (select distinct o_custkey from orders where o_orderstatus = 'F') on c_custkey = o_custkey where o_custkey is null")
def anti_left_null(t: Tables) -> DataFrame:
    done = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.lit(1).alias("seen")).distinct()
    return rel.anti_left_null(t("customer", "c_custkey", "c_name"), done, ["c_custkey"], "seen")


@report("not_in_null_aware", f"""
with {ORDERS_NULL}
select 'with_null' as right_side, o_orderkey from orders where o_orderpriority not in (select o_orderpriority from orders_null where o_orderstatus = 'F')
union all
select 'without_null', o_orderkey from orders where o_orderpriority not in (select o_orderpriority from orders_null where o_orderpriority is not null and o_orderpriority <> '1-URGENT')""")
def not_in_null_aware(t: Tables) -> DataFrame:
    nullable, orders = inputs.orders_null(t), t("orders", "o_orderkey", "o_orderpriority")
    with_null = rel.not_in(orders, "o_orderpriority", nullable.where("o_orderstatus = 'F'"), "o_orderpriority")
    clean = nullable.where("o_orderpriority is not null and o_orderpriority <> '1-URGENT'")
    without = rel.not_in(orders, "o_orderpriority", clean, "o_orderpriority")
    return rel.union_tagged({"with_null": with_null, "without_null": without}, "right_side").select("right_side", "o_orderkey")


@report("sequence_gaps", "select * from (select k as current_id, lead(k) over (order by k) as next_id, lead(k) over (order by k) - k - 1 as gap_size "
                         "from (select distinct l_orderkey as k from lineitem)) where gap_size > 0")
def sequence_gaps(t: Tables) -> DataFrame:
    return win.sequence_gaps(t.lineitem, "l_orderkey")


@report("lateral_top3", """
select c_custkey, c_name, o_orderkey, o_orderdate, o_totalprice from customer join (
  select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rn from orders
) on o_custkey = c_custkey where rn <= 3""")
def lateral_top3(t: Tables) -> DataFrame:
    recent = rel.top_per_key(t("orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["-o_orderdate", "o_orderkey"], 3)
    return t("customer", "c_custkey", "c_name").join(recent, F.expr("o_custkey = c_custkey")).drop("_rn", "o_custkey")


@report("null_safe_join", f"""
with {ORDERS_NULL},
a as (select o_orderpriority, o_orderstatus, count(*) as n_orders from orders_null group by 1, 2),
b as (select o_orderpriority, sum(cast(o_totalprice as decimal(18,2))) as total from orders_null group by 1)
select a.o_orderpriority, o_orderstatus, n_orders, cast(total as double) as total from a join b on a.o_orderpriority is not distinct from b.o_orderpriority""")
def null_safe_join(t: Tables) -> DataFrame:
    orders = inputs.orders_null(t)
    a = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n_orders"))
    b = orders.groupBy("o_orderpriority").agg(v.exact_sum("o_totalprice").alias("total"))
    return rel.null_safe_join(a, b, ["o_orderpriority"])


@report("scalar_to_join", """
select p_partkey, p_name, (select count(*) from lineitem where l_partkey = p_partkey) as line_count,
  (select sum(cast(l_quantity as decimal(18,2)))::double / count(*) from lineitem where l_partkey = p_partkey) as avg_qty from part""")
def scalar_to_join(t: Tables) -> DataFrame:
    lines = t("lineitem", F.col("l_partkey").alias("p_partkey"), "l_quantity")
    aggs = [F.count(F.lit(1)).alias("line_count"), v.exact_avg("l_quantity").alias("avg_qty")]
    return rel.lookup_agg(t("part", "p_partkey", "p_name"), lines, ["p_partkey"], aggs, ["line_count"])


@report("above_group_avg", """
select o_orderkey, o_custkey, o_totalprice, a as group_avg from orders join (
  select o_custkey as k, sum(cast(o_totalprice as decimal(18,2)))::double / count(*) as a from orders group by 1) on k = o_custkey
where o_totalprice > a""")
def above_group_avg(t: Tables) -> DataFrame:
    return rel.above_group_avg(t("orders", "o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey"], "o_totalprice")


@report("scd2_asof_join", f"""
with {CUST_VERSIONS},
lines as (select l.*, o_custkey from lineitem l join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, l_partkey, l_extendedprice, cast(l_shipdate as date) as ship_day, lines.o_custkey, priority, valid_from, valid_to
from lines join cust_versions c on c.o_custkey = lines.o_custkey and cast(l_shipdate as date) >= valid_from
 and cast(l_shipdate as date) < coalesce(valid_to, date '9999-12-31')""")
def scd2_asof_join(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t("orders", "o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_shipdate").cast("date").alias("ship_day"), "o_custkey")
    return temporal.asof_join(lines, inputs.cust_versions(t), "o_custkey", "ship_day", "valid_from", "valid_to", ["priority"])


@report("interval_overlap", """
with b as (select o_orderkey, o_custkey, cast(o_orderdate as date) as start_day, cast(o_orderdate as date) + 30 as end_day from orders)
select x.o_orderkey, x.o_custkey, x.start_day, x.end_day, count(*) as conflicts from b x join b y
  on x.o_custkey = y.o_custkey and x.start_day < y.end_day and y.start_day < x.end_day and x.o_orderkey <> y.o_orderkey group by 1, 2, 3, 4""")
def interval_overlap(t: Tables) -> DataFrame:
    return temporal.overlap_conflicts(inputs.bookings(t), "o_custkey", "start_day", "end_day")


@report("interval_pairs", """
with b as (select o_orderkey, o_custkey, cast(o_orderdate as date) as start_day, cast(o_orderdate as date) + 30 as end_day from orders)
select x.o_custkey, x.o_orderkey as first_id, y.o_orderkey as second_id, greatest(x.start_day, y.start_day) as overlap_start, least(x.end_day, y.end_day) as overlap_end
from b x join b y on x.o_custkey = y.o_custkey and x.start_day < y.end_day and y.start_day < x.end_day and x.o_orderkey < y.o_orderkey""")
def interval_pairs(t: Tables) -> DataFrame:
    return temporal.overlap_pairs(inputs.bookings(t), "o_custkey", "start_day", "end_day", "o_orderkey")


@report("prefilter_join", "select c_custkey, c_name, o_orderkey, o_totalprice from customer join orders on o_custkey = c_custkey "
                          "where c_mktsegment = 'BUILDING' and o_orderdate >= timestamp '2000-01-01'")
def prefilter_join(t: Tables) -> DataFrame:
    joined = rel.prefiltered_join(
        t.customer, F.col("c_mktsegment") == "BUILDING", t.orders, F.expr("o_orderdate >= timestamp_ntz '2000-01-01'"), F.expr("o_custkey = c_custkey"))
    return joined.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@report("gap_fill", f"""
with {DAILY},
cal as (select unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day))::date as day from daily)
select cal.day, coalesce(cast(revenue as double), 0.0) as revenue,
  cast(sum(revenue) over w as double) / nullif(count(revenue) over w, 0) as ma_7day
from cal left join daily on cal.day = daily.day window w as (order by cal.day rows between 6 preceding and current row)""")
def gap_fill(t: Tables) -> DataFrame:
    return win.fill_dates(inputs.daily_revenue(t), "day", "revenue")


@report("hinted_join", "select c_mktsegment, count(*) as n_orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders join customer on o_custkey = c_custkey group by 1")
def hinted_join(t: Tables) -> DataFrame:
    joined = rel.hinted_join(t.orders, t.customer, F.expr("o_custkey = c_custkey"), "merge")
    return joined.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), v.exact_sum("o_totalprice").alias("total"))


@report("describe_ids", "select o_orderkey, o_custkey, c_name, c_nationkey, n_name from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey")
def describe_ids(t: Tables) -> DataFrame:
    ids = t("orders", "o_orderkey", "o_custkey").join(
        t("customer", F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    return rel.describe_ids(ids, [("o_custkey", t.customer, "c_custkey", "c_name"), ("c_nationkey", t.nation, "n_nationkey", "n_name")])
