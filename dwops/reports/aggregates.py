"""Aggregations, set operations, top-k and paging."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dwops.functions import values as v
from dwops.operators import quality, relational as rel
from dwops.reports import inputs
from dwops.reports.registry import Tables, report
from dwops.reports.sql import NET_LINES, REVENUE


@report("group_agg", f"""
select l_returnflag, l_linestatus, cast(sum(cast(l_quantity as decimal(18,2))) as double) as sum_qty,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sum_base_price, cast(sum({REVENUE}) as double) as sum_disc_price,
  sum(cast(l_quantity as decimal(18,2)))::double / count(*) as avg_qty, min(l_extendedprice) as min_price, max(l_extendedprice) as max_price,
  count(*) as count_order from lineitem group by 1, 2""")
def group_agg(t: Tables) -> DataFrame:
    return rel.agg(t.lineitem, ["l_returnflag", "l_linestatus"], [
        v.exact_sum("l_quantity").alias("sum_qty"), v.exact_sum("l_extendedprice").alias("sum_base_price"),
        v.revenue_total().cast("double").alias("sum_disc_price"), v.exact_avg("l_quantity").alias("avg_qty"),
        F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"), F.count(F.lit(1)).alias("count_order"),
    ])


@report("having", "select o_custkey, count(*) as n_orders, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from orders group by 1 having count(*) > 5")
def having(t: Tables) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_orders"), v.exact_sum("o_totalprice").alias("total")]
    return rel.agg_having(t.orders, ["o_custkey"], aggs, F.col("n_orders") > 5)


@report("count_distinct", "select cast(date_trunc('month', o_orderdate) as date) as month, count(distinct o_custkey) as customers from orders group by 1")
def count_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy(v.month_of("o_orderdate").alias("month")).agg(F.count_distinct("o_custkey").alias("customers"))


STATUS = {"finished": "F", "open": "O", "pending": "P"}
CASE_SQL = """select o_orderpriority,
  cast(sum(case when o_orderstatus = 'F' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as finished,
  cast(sum(case when o_orderstatus = 'O' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as open,
  cast(sum(case when o_orderstatus = 'P' then cast(o_totalprice as decimal(18,2)) else 0 end) as double) as pending
from orders group by 1"""


@report("conditional_agg", CASE_SQL)
def conditional_agg(t: Tables) -> DataFrame:
    return rel.pivot_case(t.orders, ["o_orderpriority"], "o_orderstatus", STATUS, v.money("o_totalprice"))


@report("pivot_quarter", "select o_orderstatus, " + ", ".join(
    f"cast(sum(case when quarter(o_orderdate) = {q} then cast(o_totalprice as decimal(18,2)) end) as double) as q{q}" for q in range(1, 5)
) + " from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01' group by 1")
def pivot_quarter(t: Tables) -> DataFrame:
    year = t.orders.where("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1997-01-01'")
    quarters = year.withColumn("quarter", F.quarter("o_orderdate"))
    return rel.pivot(quarters, ["o_orderstatus"], "quarter", {f"q{q}": q for q in range(1, 5)}, v.exact_sum("o_totalprice"))


@report("unpivot", f"with w as ({CASE_SQL}) select * from (select o_orderpriority, unnest(['finished', 'open', 'pending']) as status, unnest([finished, open, pending]) as amount from w) where amount > 0")
def unpivot(t: Tables) -> DataFrame:
    return rel.unpivot(conditional_agg(t), ["o_orderpriority"], list(STATUS), "status", "amount")


@report("percentiles", "select c_mktsegment, quantile_cont(c_acctbal, 0.5) as median_bal, quantile_disc(c_acctbal, 0.9) as p90_bal from customer group by 1")
def percentiles(t: Tables) -> DataFrame:
    return rel.percentiles(t.customer, ["c_mktsegment"], "c_acctbal", {"median_bal": 0.5}, {"p90_bal": 0.9})


@report("top_values", """
with u as (select 'c_mktsegment' as "column", c_mktsegment as "value", count(*) as cnt from customer group by 2
  union all select 'c_nationkey', cast(c_nationkey as varchar), count(*) from customer group by 2)
select * from (select *, row_number() over (partition by "column" order by cnt desc, "value") as rank from u) where rank <= 5""")
def top_values(t: Tables) -> DataFrame:
    return quality.top_values(t.customer, ["c_mktsegment", "c_nationkey"], 5)


@report("string_agg", "select r_name, string_agg(n_name, ', ' order by n_name) as members from (select distinct r_name, n_name from customer "
                      "join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey) group by 1")
def string_agg(t: Tables) -> DataFrame:
    joined = rel.star_join(t("customer", "c_nationkey"), [
        (t.nation, F.expr("c_nationkey = n_nationkey")), (t.region, F.expr("n_regionkey = r_regionkey"))])
    return rel.string_agg(joined, ["r_name"], "n_name")


@report("dup_groups", """
with r as (select l_orderkey, l_linenumber, l_extendedprice, row_number() over (partition by l_orderkey, l_linenumber order by l_extendedprice) as rn,
  count(*) over (partition by l_orderkey, l_linenumber) as copies from lineitem)
select l_orderkey, l_linenumber, copies, max(case when rn = 1 then l_extendedprice end) as idx1, max(case when rn = 2 then l_extendedprice end) as idx2,
  max(case when rn = 3 then l_extendedprice end) as idx3 from r where copies > 1 group by 1, 2, 3""")
def dup_groups(t: Tables) -> DataFrame:
    return rel.first_members(t.lineitem, ["l_orderkey", "l_linenumber"], "l_extendedprice", 3)


@report("ytd_cumulative", """
with m as (select cast(year(o_orderdate) as bigint) as year, cast(date_trunc('month', o_orderdate) as date) as month, sum(cast(o_totalprice as decimal(18,2))) as s from orders group by 1, 2)
select year, month, cast(s as double) as monthly_amount, cast(sum(s) over (partition by year order by month) as double) as ytd_cumulative from m""")
def ytd_cumulative(t: Tables) -> DataFrame:
    monthly = t.orders.groupBy(v.year_of("o_orderdate").alias("year"), v.month_of("o_orderdate").alias("month")).agg(
        v.money_total("o_totalprice").alias("monthly_amount"))
    return rel.cumulative_of_agg(monthly, "year", "month", "monthly_amount", "ytd_cumulative").withColumn(
        "monthly_amount", F.col("monthly_amount").cast("double"))


@report("ratio_to_total", """
with n as (select n_name, sum(cast(o_totalprice as decimal(18,2))) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1)
select n_name, cast(total as double) as total_amount, round(cast(total as double) / cast((select sum(total) from n) as double) * 100, 2) as pct_of_total from n""")
def ratio_to_total(t: Tables) -> DataFrame:
    joined = rel.star_join(t("orders", "o_custkey", "o_totalprice"), [
        (t("customer", "c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey")), (t("nation", "n_nationkey", "n_name"), F.expr("c_nationkey = n_nationkey"))])
    totals = joined.groupBy("n_name").agg(v.money_total("o_totalprice").alias("total_amount"))
    return rel.ratio_to_total(totals, "total_amount", "pct_of_total").withColumn("total_amount", F.col("total_amount").cast("double"))


DAILY_SUMMARY_SQL = """select cast(o_orderdate as date) as day, count(*) as order_count, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as revenue,
  sum(cast(o_totalprice as decimal(18,2)))::double / count(*) as avg_order_value, count(distinct o_custkey) as unique_customers from orders group by 1"""


@report("daily_summary", DAILY_SUMMARY_SQL)
def daily_summary(t: Tables) -> DataFrame:
    return rel.daily_summary(t.orders, "o_orderdate", "o_totalprice", "o_custkey", 2)


@report("daily_summary_net", f"""with {NET_LINES} select cast(l_shipdate as date) as day, count(*) as order_count, cast(sum(net) as double) as revenue,
  sum(net)::double / count(net) as avg_order_value, count(distinct l_suppkey) as unique_customers from net_lines group by 1""")
def daily_summary_net(t: Tables) -> DataFrame:
    """Shipped lines per day over amounts of four decimals, all of which count."""
    return rel.daily_summary(inputs.net_lines(t), "l_shipdate", "net", "l_suppkey", 4)


@report("lifetime_value", "select c_custkey, c_name, coalesce(n, 0) as order_count, coalesce(s, 0.0) as lifetime_value from customer left join ("
                          "select o_custkey, count(*) as n, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as s from orders group by 1) on o_custkey = c_custkey")
def lifetime_value(t: Tables) -> DataFrame:
    facts = t("orders", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return rel.lifetime_value(t("customer", "c_custkey", "c_name"), facts, ["c_custkey"], "o_totalprice", 2)


@report("lifetime_value_net", f"""with {NET_LINES} select s_suppkey, s_name, coalesce(n, 0) as order_count, coalesce(s, 0.0) as lifetime_value
from supplier left join (select l_suppkey, count(*) as n, cast(sum(net) as double) as s from net_lines group by 1) on l_suppkey = s_suppkey""")
def lifetime_value_net(t: Tables) -> DataFrame:
    facts = inputs.net_lines(t).withColumnRenamed("l_suppkey", "s_suppkey")
    return rel.lifetime_value(t("supplier", "s_suppkey", "s_name"), facts, ["s_suppkey"], "net", 4)


@report("slowest_groups", """
select user_id, count(*) as calls, cast(sum(cast(value as decimal(18,2))) as double) as total_time, sum(cast(value as decimal(18,2)))::double / count(*) as mean_time,
  max(value) as max_time from events group by 1 order by mean_time desc, user_id limit 20""")
def slowest_groups(t: Tables) -> DataFrame:
    return rel.slowest_groups(t.events, ["user_id"], "value", 20)


@report("cohort_retention", """
with a as (select distinct o_custkey, cast(date_trunc('month', o_orderdate) as date) as activity_month from orders),
c as (select o_custkey, min(activity_month) as cohort_month from a group by 1),
s as (select cohort_month, count(*) as cohort_size from c group by 1)
select c.cohort_month, activity_month, count(*) as active_users, cohort_size,
  cast(12 * (year(activity_month) - year(c.cohort_month)) + month(activity_month) - month(c.cohort_month) as bigint) as months_since_signup,
  round(100.0::double * count(*) / cohort_size, 2) as retention_pct
from a join c using (o_custkey) join s on s.cohort_month = c.cohort_month group by 1, 2, 4, 5""")
def cohort_retention(t: Tables) -> DataFrame:
    return rel.cohort_retention(t.orders, "o_custkey", "o_orderdate")


# --- set operations --------------------------------------------------------

@report("set_union", "select c_nationkey as nationkey from customer union select s_nationkey from supplier")
def set_union(t: Tables) -> DataFrame:
    return rel.union_distinct(t("customer", F.col("c_nationkey").alias("nationkey")), t("supplier", "s_nationkey"))


@report("set_union_all", "select user_id, 'signup' as event from events where event_type = 'signup' union all select user_id, 'purchase' from events where event_type = 'purchase'")
def set_union_all(t: Tables) -> DataFrame:
    users = lambda kind: t.events.where(F.col("event_type") == kind).select("user_id")
    return rel.union_tagged({"signup": users("signup"), "purchase": users("purchase")}, "event")


@report("set_intersect", "select user_id, cast(ts as date) as day from events where event_type = 'error' intersect select user_id, cast(ts as date) from events where event_type = 'purchase'")
def set_intersect(t: Tables) -> DataFrame:
    users = lambda kind: t.events.where(F.col("event_type") == kind).select("user_id", F.col("ts").cast("date").alias("day"))
    return rel.intersect(users("error"), users("purchase"))


@report("set_except", "select doc_id from documents except select doc_id from labels")
def set_except(t: Tables) -> DataFrame:
    return rel.except_(t("documents", "doc_id"), t("labels", "doc_id"))


# --- top-k and paging ------------------------------------------------------

@report("top_k", "select o_orderkey, o_custkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def top_k(t: Tables) -> DataFrame:
    return rel.top_k(t("orders", "o_orderkey", "o_custkey", "o_totalprice"), ["-o_totalprice", "o_orderkey"], 20)


@report("page_offset", "select p_partkey, p_name from part order by p_partkey limit 10 offset 20")
def page_offset(t: Tables) -> DataFrame:
    return rel.page(t("part", "p_partkey", "p_name"), ["p_partkey"], 10, 20)


@report("page_row_number", "select * from (select p_partkey, p_name, row_number() over (order by p_partkey) as rn from part) where rn between 21 and 30")
def page_row_number(t: Tables) -> DataFrame:
    return rel.page_rows(t("part", "p_partkey", "p_name"), ["p_partkey"], 21, 30)


@report("page_keyset", "select p_partkey, p_name from part where p_partkey > 29 order by p_partkey limit 10")
def page_keyset(t: Tables) -> DataFrame:
    return rel.page_after(t("part", "p_partkey", "p_name"), "p_partkey", 29, 10)
