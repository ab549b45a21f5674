"""Window analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from dwops.functions import values as v
from dwops.operators import relational as rel, windows as win
from dwops.reports import inputs
from dwops.reports.registry import Tables, report
from dwops.reports.sql import DAILY, NET_LINES, REVENUE

SPEND = "spend as (select o_custkey, sum(cast(o_totalprice as decimal(18,2))) as total_spent from orders group by 1)"


def _spend(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(v.money_total("o_totalprice").alias("total_spent"))


@report("row_number", "select o_custkey, o_orderkey, o_orderdate, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as row_num from orders")
def row_number(t: Tables) -> DataFrame:
    return win.row_number_by(t("orders", "o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["-o_orderdate", "o_orderkey"])


@report("latest_per_key", "select o_custkey, o_orderkey, o_orderdate, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1")
def latest_per_key(t: Tables) -> DataFrame:
    return win.latest_per_key(t("orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], ["-o_orderdate", "-o_orderkey"])


@report("ranking", """select p_partkey, p_size, rank() over (order by p_size desc) as rank, dense_rank() over (order by p_size desc) as dense_rank,
  row_number() over (order by p_size desc, p_partkey) as row_num from part""")
def ranking(t: Tables) -> DataFrame:
    return win.rank_all(t("part", "p_partkey", "p_size"), [], "-p_size", ["p_partkey"])


@report("ntile", f"""with {SPEND} select o_custkey, cast(total_spent as double) as total_spent, ntile(4) over (order by total_spent desc, o_custkey) as quartile,
  ntile(10) over (order by total_spent desc, o_custkey) as decile from spend""")
def ntile(t: Tables) -> DataFrame:
    tiles = win.ntile_by(_spend(t), {"quartile": 4, "decile": 10}, ["-total_spent", "o_custkey"])
    return tiles.withColumn("total_spent", F.col("total_spent").cast("double"))


@report("running_total_range", "select o_orderkey, o_orderdate, cast(sum(cast(o_totalprice as decimal(18,2))) over (order by o_orderdate) as double) as running_total from orders")
def running_total_range(t: Tables) -> DataFrame:
    out = win.running(t("orders", "o_orderkey", "o_orderdate", "o_totalprice"), v.money("o_totalprice"), ["o_orderdate"], frame="range")
    return out.select("o_orderkey", "o_orderdate", F.col("running_total").cast("double").alias("running_total"))


@report("running_total_rows", "select o_orderkey, cast(sum(cast(o_totalprice as decimal(18,2))) over (order by o_orderdate, o_orderkey rows unbounded preceding) as double) as running_total from orders")
def running_total_rows(t: Tables) -> DataFrame:
    out = win.running(t("orders", "o_orderkey", "o_orderdate", "o_totalprice"), v.money("o_totalprice"), ["o_orderdate", "o_orderkey"])
    return out.select("o_orderkey", F.col("running_total").cast("double").alias("running_total"))


MEAN = "cast(sum(revenue) over {w} as double) / count(revenue) over {w}"


@report("moving_avg_rows", f"""with {DAILY} select day, cast(revenue as double) as revenue, {MEAN.format(w='(order by day rows between 6 preceding and current row)')} as moving_avg_7d,
  {MEAN.format(w='(order by day rows between 2 preceding and current row)')} as ma_3 from daily""")
def moving_avg_rows(t: Tables) -> DataFrame:
    week = win.moving_rows(inputs.daily_revenue(t), ["day"], 6, 0, {"_s7": F.sum("revenue"), "_n7": F.count("revenue")}, bounded=True)
    both = win.moving_rows(week, ["day"], 2, 0, {"_s3": F.sum("revenue"), "_n3": F.count("revenue")}, bounded=True)
    mean = lambda n: F.col(f"_s{n}").cast("double") / F.col(f"_n{n}")
    return both.select("day", F.col("revenue").cast("double").alias("revenue"), mean(7).alias("moving_avg_7d"), mean(3).alias("ma_3"))


@report("moving_avg_range", """
select event_id, user_id, ts, count(*) over w as events_7d, cast(sum(cast(value as decimal(18,2))) over w as double) as value_7d
from events window w as (partition by user_id order by ts range between interval 7 days preceding and current row)""")
def moving_avg_range(t: Tables) -> DataFrame:
    out = win.moving_interval(t("events", "event_id", "user_id", "ts", "value"), "ts", "7 days", "0 days",
                              {"events_7d": F.lit(1).cast("long"), "value_7d": v.money("value")}, ["user_id"])
    return out.withColumn("value_7d", F.col("value_7d").cast("double")).drop("value")


@report("moving_extremes", """
select event_id, user_id, ts, min(value) over back as min_7d, max(value) over back as max_7d, cast(sum(cast(value as decimal(18,2))) over back as double) / count(value) over back as avg_7d,
  min(value) over around as min_around, max(value) over around as max_around, count(*) over around as events_around
from events window back as (partition by user_id order by ts range between interval 7 days preceding and current row),
  around as (partition by user_id order by ts range between interval 12 hours preceding and interval 12 hours following)""")
def moving_extremes(t: Tables) -> DataFrame:
    events, value = t("events", "event_id", "user_id", "ts", "value"), F.col("value")
    back = win.interval_frames(events, "ts", "7 days", "0 days", {"min_7d": ("min", value), "max_7d": ("max", value), "avg_7d": ("avg", v.money("value"))}, ["user_id"])
    around = {"min_around": ("min", value), "max_around": ("max", value), "events_around": ("count", F.lit(1))}
    return win.interval_frames(back, "ts", "12 hours", "12 hours", around, ["user_id"]).drop("value")


@report("centered_frames", f"""with {DAILY} select day, cast(sum(revenue) over (order by day rows between 2 preceding and 2 following) as double) as sum_5_rows,
  cast(sum(revenue) over (order by day range between interval 2 days preceding and interval 2 days following) as double) as sum_5_day_range,
  {MEAN.format(w='(order by day rows between 3 preceding and 3 following)')} as centered_ma_7 from daily""")
def centered_frames(t: Tables) -> DataFrame:
    """One row per day, so every step knows its groups to be short."""
    days = inputs.daily_revenue(t)
    by_rows = win.moving_rows(days, ["day"], 2, 2, {"sum_5_rows": F.sum("revenue")}, bounded=True)
    wide = win.moving_rows(by_rows, ["day"], 3, 3, {"_s": F.sum("revenue"), "_n": F.count("revenue")}, bounded=True)
    ranged = win.moving_interval(wide, "day", "2 days", "2 days", {"sum_5_day_range": F.col("revenue")}, bounded=True)
    return ranged.select(
        "day", F.col("sum_5_rows").cast("double").alias("sum_5_rows"), F.col("sum_5_day_range").cast("double").alias("sum_5_day_range"),
        (F.col("_s").cast("double") / F.col("_n")).alias("centered_ma_7"))


@report("partition_share", """
select l_partkey, l_orderkey, l_quantity, sum(cast(l_quantity as decimal(18,2))) over (partition by l_partkey)::double / count(*) over (partition by l_partkey) as group_avg,
  l_quantity / nullif(cast(sum(cast(l_quantity as decimal(18,2))) over (partition by l_partkey) as double), 0) as pct_of_total from lineitem""")
def partition_share(t: Tables) -> DataFrame:
    return win.partition_share(t("lineitem", "l_partkey", "l_orderkey", "l_quantity"), ["l_partkey"], "l_quantity")


@report("running_qty_by_part", """
select l_partkey, l_orderkey, l_shipdate, cast(sum(cast(l_quantity as decimal(18,2))) over (partition by l_partkey order by l_shipdate) as double) as cumulative_qty from lineitem""")
def running_qty_by_part(t: Tables) -> DataFrame:
    out = win.running(t("lineitem", "l_partkey", "l_orderkey", "l_shipdate", "l_quantity"), v.money("l_quantity"), ["l_shipdate"],
                      ["l_partkey"], "range", "cumulative_qty")
    return out.withColumn("cumulative_qty", F.col("cumulative_qty").cast("double")).drop("l_quantity")


@report("yearly_total", "select o_orderkey, cast(year(o_orderdate) as bigint) as period, cast(sum(cast(o_totalprice as decimal(18,2))) over (partition by year(o_orderdate)) as double) as yearly_total from orders")
def yearly_total(t: Tables) -> DataFrame:
    out = win.period_total(t("orders", "o_orderkey", "o_orderdate", "o_totalprice"), v.year_of("o_orderdate"), "o_totalprice", "yearly_total", 2)
    return out.select("o_orderkey", "period", "yearly_total")


@report("yearly_total_net", f"""with {NET_LINES} select l_orderkey, l_suppkey, cast(year(l_shipdate) as bigint) as period,
  cast(sum(net) over (partition by year(l_shipdate)) as double) as yearly_total from net_lines""")
def yearly_total_net(t: Tables) -> DataFrame:
    out = win.period_total(inputs.net_lines(t), v.year_of("l_shipdate"), "net", "yearly_total", 4)
    return out.select("l_orderkey", "l_suppkey", "period", "yearly_total")


@report("lag_lead", f"""with {DAILY} select day, cast(revenue as double) as revenue, cast(lag(revenue) over (order by day) as double) as previous_value,
  cast(lead(revenue) over (order by day) as double) as next_value, cast(revenue - lag(revenue) over (order by day) as double) as change from daily""")
def lag_lead(t: Tables) -> DataFrame:
    out = win.lag_lead(inputs.daily_revenue(t), "revenue", ["day"], bounded=True)
    return out.withColumns({c: F.col(c).cast("double") for c in ("revenue", "previous_value", "next_value", "change")})


@report("time_gaps", """select * from (select o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) over w as prev_date,
  date_diff('day', lag(o_orderdate) over w, o_orderdate) as days_since_last from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)) where days_since_last > 7""")
def time_gaps(t: Tables) -> DataFrame:
    return win.time_gaps(t("orders", "o_custkey", "o_orderkey", "o_orderdate"), "o_orderdate", ["o_custkey"], 7, ["o_orderkey"])


SESSIONS_SQL = """
with p as (select event_id, user_id, ts, lag(ts) over (partition by user_id order by ts, event_id) as prev_action from events),
f as (select *, (epoch_us(ts) - epoch_us(prev_action)) / 1000000.0::double / 60 as minutes_since_last from p),
g as (select *, case when minutes_since_last > 30 then 1 else 0 end as flag from f)
select event_id, user_id, ts, prev_action, minutes_since_last, cast(flag as bigint) as new_session,
  cast(sum(flag) over (partition by user_id order by ts, event_id) as bigint) as session_id from g"""


@report("sessionize", SESSIONS_SQL)
def sessionize(t: Tables) -> DataFrame:
    return win.sessionize(t("events", "event_id", "user_id", "ts"), "user_id", "ts", ["event_id"])


@report("first_last_value", """
select o_custkey, o_orderkey, o_totalprice, first_value(o_totalprice) over w as initial_value, last_value(o_totalprice) over w as current_value,
  o_totalprice - first_value(o_totalprice) over w as change_from_start from orders
window w as (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following)""")
def first_last_value(t: Tables) -> DataFrame:
    out = win.first_last(t("orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_totalprice", ["o_orderdate", "o_orderkey"], ["o_custkey"])
    return out.drop("o_orderdate")


@report("nth_value", """
select o_custkey, o_orderkey, nth_value(o_totalprice, 2) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as second_amount from orders""")
def nth_value(t: Tables) -> DataFrame:
    out = win.nth_value_by(t("orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), "o_totalprice", 2, ["o_orderdate", "o_orderkey"], ["o_custkey"], "second_amount")
    return out.select("o_custkey", "o_orderkey", "second_amount")


@report("percent_rank", "select c_custkey, c_mktsegment, c_acctbal, percent_rank() over w as pct_rank, cume_dist() over w as cume_dist from customer window w as (partition by c_mktsegment order by c_acctbal)")
def percent_rank(t: Tables) -> DataFrame:
    return win.percent_ranks(t("customer", "c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", ["c_mktsegment"])


@report("filtered_window", """
select l_partkey, l_orderkey, l_linenumber, l_shipdate, l_quantity,
  cast(sum(cast(l_quantity as decimal(18,2))) filter (where l_quantity > 10) over (partition by l_partkey order by l_shipdate) as double) as cumulative_large,
  count(*) filter (where l_quantity > 40) over (partition by l_partkey) as bulk_lines,
  cast(sum(cast(l_quantity as decimal(18,2))) filter (where l_quantity < 20) over (partition by l_partkey) as double)
    / nullif(count(*) filter (where l_quantity < 20) over (partition by l_partkey), 0) as avg_small from lineitem""")
def filtered_window(t: Tables) -> DataFrame:
    lines = t("lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
    run = win.filtered_running(lines, F.col("l_quantity") > 10, v.money("l_quantity"), ["l_shipdate"], ["l_partkey"], "cumulative_large")
    out = win.filtered_totals(run, ["l_partkey"], {
        "bulk_lines": (F.col("l_quantity") > 40, None, "count"), "avg_small": (F.col("l_quantity") < 20, v.money("l_quantity"), "avg")})
    return out.withColumn("cumulative_large", F.col("cumulative_large").cast("double"))


@report("yoy_lag12", """
with m as (select cast(date_trunc('month', o_orderdate) as date) as month, sum(cast(o_totalprice as decimal(18,2))) as revenue from orders group by 1),
cal as (select unnest(generate_series((select min(month) from m)::timestamp, (select max(month) from m)::timestamp, interval 1 month))::date as month)
select month, cast(revenue as double) as revenue, cast(lag(revenue, 12) over (order by month) as double) as previous_value from cal left join m using (month)""")
def yoy_lag12(t: Tables) -> DataFrame:
    monthly = t.orders.groupBy(v.month_of("o_orderdate").alias("month")).agg(v.money_total("o_totalprice").alias("revenue"))
    out = win.yoy_lag(monthly, "month", "revenue")
    return out.select("month", F.col("revenue").cast("double").alias("revenue"), F.col("previous_value").cast("double").alias("previous_value"))


@report("yoy_join", f"""
with s as (select l_partkey, year(o_orderdate) as y, sum({REVENUE}) as amount from lineitem join orders on l_orderkey = o_orderkey where year(o_orderdate) in (1996, 1997) group by 1, 2)
select c.l_partkey, cast(c.amount as double) as cy_amount, cast(p.amount as double) as py_amount,
  round(100.0::double * cast(c.amount - p.amount as double) / nullif(cast(p.amount as double), 0), 2) as yoy_growth_pct
from (select * from s where y = 1997) c left join (select * from s where y = 1996) p on c.l_partkey = p.l_partkey""")
def yoy_join(t: Tables) -> DataFrame:
    orders = t("orders", "o_orderkey", "o_orderdate").where("o_orderdate >= timestamp_ntz '1996-01-01' and o_orderdate < timestamp_ntz '1998-01-01'")
    sold = t("lineitem", "l_orderkey", "l_partkey", "l_extendedprice", "l_discount").join(orders, F.expr("l_orderkey = o_orderkey"))
    return rel.year_over_year(sold, ["l_partkey"], F.year("o_orderdate"), v.revenue_units(), 4, 1997)


@report("dedup_priority", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice from lineitem
qualify row_number() over (partition by l_orderkey, l_linenumber order by l_extendedprice desc, l_partkey, l_suppkey) = 1""")
def dedup_priority(t: Tables) -> DataFrame:
    lines = t("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return win.dedup(lines, ["l_orderkey", "l_linenumber"], ["-l_extendedprice", "l_partkey", "l_suppkey"])


@report("top_n_groups", """
with n as (select n_name, sum(cast(o_totalprice as decimal(18,2))) as total from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1)
select * from (select n_name, cast(total as double) as total, row_number() over (order by total desc, n_name) as rank from n) where rank <= 10""")
def top_n_groups(t: Tables) -> DataFrame:
    joined = rel.star_join(t("orders", "o_custkey", "o_totalprice"), [
        (t("customer", "c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey")), (t("nation", "n_nationkey", "n_name"), F.expr("c_nationkey = n_nationkey"))])
    return rel.top_n_groups(joined, ["n_name"], v.money_total("o_totalprice"), 10)


@report("category_rank", """
with s as (select p_partkey, p_brand, count(*) as sales_count from lineitem join part on l_partkey = p_partkey group by 1, 2)
select p_partkey, p_brand, sales_count, rank() over (partition by p_brand order by sales_count desc) as category_rank, percent_rank() over (order by sales_count desc) as overall_percentile from s""")
def category_rank(t: Tables) -> DataFrame:
    counts = t("lineitem", F.col("l_partkey").alias("p_partkey")).groupBy("p_partkey").agg(F.count(F.lit(1)).alias("sales_count"))
    return win.category_rank(counts.join(t("part", "p_partkey", "p_brand"), "p_partkey"), "p_brand", "sales_count")


@report("global_stats", "select sum(cast(p_retailprice as decimal(18,2)))::double / count(*) as avg_price, min(p_retailprice) as min_price, max(p_retailprice) as max_price, count(*) as parts from part")
def global_stats(t: Tables) -> DataFrame:
    return rel.global_stats(t.part, {"avg_price": v.exact_avg("p_retailprice"), "min_price": F.min("p_retailprice"),
                                     "max_price": F.max("p_retailprice"), "parts": F.count(F.lit(1))})


@report("nation_year_revenue", f"""
with r as (select n_name, cast(year(o_orderdate) as bigint) as year, sum({REVENUE}) as s
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2)
select n_name, year, cast(s as double) as revenue, cast(sum(s) over (partition by n_name order by year) as double) as cumulative_revenue,
  round(cast(s as double) / cast(sum(s) over (partition by year) as double) * 100, 2) as pct_of_year from r""")
def nation_year_revenue(t: Tables) -> DataFrame:
    """Star join, aggregate, running total and share: the flagship query."""
    joined = rel.star_join(t("lineitem", "l_orderkey", "l_extendedprice", "l_discount"), [
        (t("orders", "o_orderkey", "o_custkey", "o_orderdate"), F.expr("l_orderkey = o_orderkey")),
        (t("customer", "c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey")),
        (t("nation", "n_nationkey", "n_name"), F.expr("c_nationkey = n_nationkey"))])
    sums = joined.groupBy("n_name", v.year_of("o_orderdate").alias("year")).agg(v.revenue_total().alias("revenue"))
    run = rel.cumulative_of_agg(sums, "n_name", "year", "revenue", "cumulative_revenue")
    of_year = F.sum("revenue").over(Window.partitionBy("year")).cast("double")
    share = F.round(F.col("revenue").cast("double") / of_year * 100, 2)
    return run.withColumn("pct_of_year", share).withColumn("revenue", F.col("revenue").cast("double"))
