"""Dimension and fact loading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dwops.functions import values as v
from dwops.operators import distinct, loading, temporal
from dwops.reports import inputs
from dwops.reports.registry import Tables, report
from dwops.reports.sql import CUST_STAGE, CUST_VERSIONS, NET_LINES, PART_NEW
from dwops.session import fresh_path


@report("scd1_merge", f"""with {CUST_STAGE}
select coalesce(s.c_custkey, d.c_custkey) as c_custkey, case when s.c_custkey is null then d.c_name else s.c_name end as c_name,
  case when s.c_custkey is null then d.c_nationkey else s.c_nationkey end as c_nationkey,
  case when s.c_custkey is null then d.c_acctbal else s.c_acctbal end as c_acctbal,
  case when s.c_custkey is null then d.c_mktsegment else s.c_mktsegment end as c_mktsegment
from customer d full join cust_stage s on d.c_custkey = s.c_custkey""")
def scd1_merge(t: Tables) -> DataFrame:
    return loading.scd1_merge(t.customer, inputs.cust_stage(t), "c_custkey")


@report("upsert", f"""with {PART_NEW}
select coalesce(t.p_partkey, s.p_partkey) as p_partkey, coalesce(t.p_name, s.p_name) as p_name,
  case when t.p_partkey is not null and s.p_partkey is not null then s.p_size + t.p_size when t.p_partkey is null then s.p_size else t.p_size end as p_size,
  case when t.p_partkey is null then 0.0 else t.p_retailprice end as p_retailprice
from part t full join part_new s on t.p_partkey = s.p_partkey""")
def upsert(t: Tables) -> DataFrame:
    target = t("part", "p_partkey", "p_name", "p_size", "p_retailprice")
    source = inputs.part_new(t).select("p_partkey", "p_name", "p_size")
    return loading.upsert(
        target, source, ["p_partkey"], update={"p_size": F.col("s.p_size") + F.col("t.p_size")},
        insert={"p_partkey": F.col("s.p_partkey"), "p_name": F.col("s.p_name"), "p_size": F.col("s.p_size"), "p_retailprice": F.lit(0.0)})


@report("scd2_apply", f"""
with {CUST_STAGE},
dim as (select c_custkey, c_name, c_mktsegment, date '1995-01-01' as valid_from, cast(null as date) as valid_to, true as is_current from customer),
j as (select d.*, s.c_custkey as k, s.c_name as n, s.c_mktsegment as m, d.c_custkey is not null and (s.c_custkey is null or (d.c_name is not distinct from s.c_name and d.c_mktsegment is not distinct from s.c_mktsegment)) as keep
  from dim d full join cust_stage s on d.c_custkey = s.c_custkey),
first_load as (
  select c_custkey, c_name, c_mktsegment, valid_from, case when keep then valid_to else date '2000-01-01' end as valid_to, keep as is_current from j where c_custkey is not null
  union all select k, n, m, date '2000-01-01', null, true from j where k is not null and not keep),
snap as (select c_custkey, c_name, 'MERGED' as c_mktsegment from customer where c_mktsegment in ('BUILDING', 'FURNITURE')),
j2 as (select f.*, s.c_custkey as k, s.c_name as n, s.c_mktsegment as m, s.c_custkey is null or (f.c_name is not distinct from s.c_name and f.c_mktsegment is not distinct from s.c_mktsegment) as keep
  from (select * from first_load where is_current) f left join snap s on f.c_custkey = s.c_custkey)
select * from first_load where not is_current
union all select c_custkey, c_name, c_mktsegment, valid_from, case when keep then valid_to else date '2001-01-01' end, keep from j2
union all select k, n, m, date '2001-01-01', null, true from j2 where k is not null and not keep""")
def scd2_apply(t: Tables) -> DataFrame:
    columns = ["c_name", "c_mktsegment"]
    dim = temporal.first_versions(t("customer", "c_custkey", *columns), "1995-01-01")
    first = temporal.scd2_apply(dim, inputs.cust_stage(t), "c_custkey", columns, "2000-01-01")
    merged = t.customer.where("c_mktsegment in ('BUILDING', 'FURNITURE')").withColumn("c_mktsegment", F.lit("MERGED"))
    return temporal.scd2_apply(first, merged, "c_custkey", columns, "2001-01-01")


@report("scd2_history", f"with {CUST_VERSIONS} select *, valid_to is null as is_current from cust_versions")
def scd2_history(t: Tables) -> DataFrame:
    return inputs.cust_versions(t)


@report("scd2_current", f"with {CUST_VERSIONS} select o_custkey, priority, valid_from from cust_versions where valid_to is null")
def scd2_current(t: Tables) -> DataFrame:
    return temporal.scd2_current(inputs.cust_versions(t)).select("o_custkey", "priority", "valid_from")


@report("scd2_at", f"with {CUST_VERSIONS} select o_custkey, priority, valid_from, valid_to from cust_versions where valid_from <= date '1998-06-30' and date '1998-06-30' < coalesce(valid_to, date '9999-12-31')")
def scd2_at(t: Tables) -> DataFrame:
    return temporal.scd2_at(inputs.cust_versions(t), "1998-06-30").drop("is_current")


@report("scd3_apply", f"""with {CUST_STAGE}
select d.c_custkey, d.c_name, case when s.c_custkey is not null then s.c_mktsegment else d.c_mktsegment end as c_mktsegment,
  case when s.c_mktsegment is distinct from d.c_mktsegment and s.c_custkey is not null then d.c_mktsegment end as previous_c_mktsegment
from customer d left join cust_stage s on d.c_custkey = s.c_custkey""")
def scd3_apply(t: Tables) -> DataFrame:
    return temporal.scd3_apply(t("customer", "c_custkey", "c_name", "c_mktsegment"), inputs.cust_stage(t), "c_custkey", "c_mktsegment")


@report("surrogate_keys", f"""with {CUST_STAGE},
dim as (select c_custkey, c_custkey + 1000 as customer_key from customer)
select c_custkey, c_name, (select max(customer_key) from dim) + row_number() over (order by c_custkey) as customer_key
from cust_stage s where not exists (select 1 from dim d where d.c_custkey = s.c_custkey)""")
def surrogate_keys(t: Tables) -> DataFrame:
    dim = t.customer.select("c_custkey", (F.col("c_custkey") + 1000).alias("customer_key"))
    stage = inputs.cust_stage(t).select("c_custkey", "c_name")
    return loading.assign_keys(dim, stage, "c_custkey", "customer_key")


CONTROL = "etl_control as (select 'orders' as table_name, max(o_orderdate) - interval 365 days as load_date from orders)"


@report("incremental_load", f"with {CONTROL} select o_orderkey, o_custkey, o_orderdate from orders where o_orderdate > (select max(load_date) from etl_control where table_name = 'orders')")
def incremental_load(t: Tables) -> DataFrame:
    return loading.incremental(t("orders", "o_orderkey", "o_custkey", "o_orderdate"), inputs.etl_control(t), "orders", "o_orderdate")


@report("incremental_mark", f"with {CONTROL}, l as (select * from orders where o_orderdate > (select max(load_date) from etl_control)) select 'orders' as table_name, max(o_orderdate) as load_date, count(*) as loaded_rows from l")
def incremental_mark(t: Tables) -> DataFrame:
    control = inputs.etl_control(t)
    loaded = loading.incremental(t("orders", "o_orderkey", "o_orderdate"), control, "orders", "o_orderdate")
    return loading.next_mark(loaded, control, "orders", "o_orderdate")


JSON_ROW = "to_json({{'p_partkey': {0}.p_partkey, 'p_name': {0}.p_name, 'p_size': {0}.p_size, 'p_retailprice': {0}.p_retailprice}})"


@report("audit_diff", f"""with {PART_NEW}
select * from (select coalesce(o.p_partkey, n.p_partkey) as record_id,
  case when o.p_partkey is null then 'INSERT' when n.p_partkey is null then 'DELETE'
    when o.p_name is distinct from n.p_name or o.p_size is distinct from n.p_size or o.p_retailprice is distinct from n.p_retailprice then 'UPDATE' end as action,
  case when o.p_partkey is not null then cast({JSON_ROW.format('o')} as varchar) end as old_values,
  case when n.p_partkey is not null then cast({JSON_ROW.format('n')} as varchar) end as new_values
from part o full join part_new n on o.p_partkey = n.p_partkey) where action is not null""")
def audit_diff(t: Tables) -> DataFrame:
    columns = ["p_partkey", "p_name", "p_size", "p_retailprice"]
    return loading.audit_diff(t("part", *columns), inputs.part_new(t).select(*columns), "p_partkey")


@report("system_versioned", f"""with {PART_NEW},
j as (select o.p_partkey as ok, o.p_name as oname, o.p_size as osize, n.p_partkey as nk, n.p_name as nname, n.p_size as nsize,
  o.p_partkey is not null and n.p_partkey is not null and o.p_name is not distinct from n.p_name and o.p_size is not distinct from n.p_size as keep
  from part o full join part_new n on o.p_partkey = n.p_partkey)
select ok as p_partkey, oname as p_name, osize as p_size, date '1995-01-01' as valid_from, case when keep then cast(null as date) else date '2000-01-01' end as valid_to, keep as is_current from j where ok is not null
union all select nk, nname, nsize, date '2000-01-01', null, true from j where nk is not null and not keep""")
def system_versioned(t: Tables) -> DataFrame:
    history = temporal.first_versions(t("part", "p_partkey", "p_name", "p_size"), "1995-01-01")
    return temporal.version_table(history, inputs.part_new(t).select("p_partkey", "p_name", "p_size"), "p_partkey", "2000-01-01")


SUMMARY_SQL = """select cast(date_trunc('month', l_shipdate) as date) as month, l_partkey, count(*) as cnt,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total_amount, min(l_extendedprice) as min_amount, max(l_extendedprice) as max_amount from lineitem group by 1, 2"""


def _summary(df: DataFrame) -> DataFrame:
    return loading.build_summary(df, [v.month_of("l_shipdate").alias("month"), "l_partkey"], "l_extendedprice", 2)


@report("summary_build", SUMMARY_SQL)
def summary_build(t: Tables) -> DataFrame:
    return _summary(t.lineitem).withColumn("total_amount", F.col("total_amount").cast("double"))


@report("summary_refresh", SUMMARY_SQL)
def summary_refresh(t: Tables) -> DataFrame:
    """Summary of what shipped before 2000, refreshed with the rest: equal to a rebuild."""
    early = F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    out = loading.refresh_summary(_summary(t.lineitem.where(early)), _summary(t.lineitem.where(~early)))
    return out.withColumn("total_amount", F.col("total_amount").cast("double"))


NET_SUMMARY_SQL = f"""with {NET_LINES} select cast(date_trunc('month', l_shipdate) as date) as month, l_suppkey, count(*) as cnt,
  cast(sum(net) as double) as total_amount, cast(min(net) as double) as min_amount, cast(max(net) as double) as max_amount from net_lines group by 1, 2"""


@report("summary_refresh_net", NET_SUMMARY_SQL)
def summary_refresh_net(t: Tables) -> DataFrame:
    """A summary of amounts with four decimals, refreshed: equal to a rebuild, nothing rounded away."""
    lines, early = inputs.net_lines(t), F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz")
    parts = [loading.build_summary(lines.where(p), [v.month_of("l_shipdate").alias("month"), "l_suppkey"], "net", 4) for p in (early, ~early)]
    return loading.refresh_summary(*parts).withColumn("total_amount", F.col("total_amount").cast("double"))


# Who bought a part in a month: a summary whose distinct counts are refreshed and rolled up, too.
BUYERS_SQL = """with bought as (
  select cast(date_trunc('month', l_shipdate) as date) as month, l_partkey, l_extendedprice, o_custkey from lineitem join orders on l_orderkey = o_orderkey)"""


def _bought(t: Tables) -> DataFrame:
    lines = t("lineitem", "l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice")
    joined = lines.join(t("orders", "o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
    return joined.select(v.month_of("l_shipdate").alias("month"), "l_partkey", "l_extendedprice", "o_custkey")


def _two_loads(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What shipped before July 1999, and the rest with that June once more, as late rows come."""
    cut, again = (F.lit(d).cast("date") for d in ("1999-07-01", "1999-06-01"))
    return df.where(F.col("month") < cut), df.where(F.col("month") >= again)


@report("summary_refresh_distinct", f"""{BUYERS_SQL}
select month, l_partkey, count(*) as cnt, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total_amount, min(l_extendedprice) as min_amount,
  max(l_extendedprice) as max_amount, count(distinct o_custkey) as customers from bought group by 1, 2""")
def summary_refresh_distinct(t: Tables) -> DataFrame:
    """The refreshed summary with exact counts of distinct customers, as a rebuild gives them."""
    bought, keys = _bought(t), ["month", "l_partkey"]
    cut = F.lit("1999-07-01").cast("date")
    first, second = (bought.where(F.col("month") < cut), bought.where(F.col("month") >= cut))
    summary = loading.refresh_summary(*[loading.build_summary(part, keys, "l_extendedprice", 2) for part in (first, second)])
    bits = distinct.merge_bits(*[distinct.id_bits(part, keys, "o_custkey") for part in (first, second)])
    return distinct.with_distinct(summary, bits, "customers").withColumn("total_amount", F.col("total_amount").cast("double"))


@report("distinct_rollup", f"""{BUYERS_SQL}
select year(month) as year, l_partkey % 25 as part_group, count(distinct o_custkey) as customers from bought group by 1, 2""")
def distinct_rollup(t: Tables) -> DataFrame:
    """Distinct customers per year and group of parts from the monthly sets; rows loaded twice count once."""
    bits = distinct.merge_bits(*[distinct.id_bits(part, ["month", "l_partkey"], "o_custkey") for part in _two_loads(_bought(t))])
    yearly = distinct.roll_up_bits(bits, [v.year_of("month").alias("year"), (F.col("l_partkey") % 25).alias("part_group")])
    return distinct.count_bits(yearly, "customers")


@report("fact_transaction", """
select cast(strftime(l_shipdate, '%Y%m%d') as bigint) as ship_date_key, cast(strftime(o_orderdate, '%Y%m%d') as bigint) as order_date_key, o_custkey as customer_key,
  l_partkey as part_key, l_suppkey as supplier_key, l_quantity, l_extendedprice, l_discount from lineitem join orders on l_orderkey = o_orderkey""")
def fact_transaction(t: Tables) -> DataFrame:
    joined = t.lineitem.join(t("orders", "o_orderkey", "o_custkey", "o_orderdate"), F.expr("l_orderkey = o_orderkey"))
    return loading.transaction_fact(joined, {
        "ship_date_key": loading.date_key("l_shipdate"), "order_date_key": loading.date_key("o_orderdate"), "customer_key": F.col("o_custkey"),
        "part_key": F.col("l_partkey"), "supplier_key": F.col("l_suppkey")}, ["l_quantity", "l_extendedprice", "l_discount"])


@report("fact_snapshot", """
with y as (select o_custkey, year(o_orderdate) as year, sum(cast(o_totalprice as decimal(18,2))) as s, count(*) as n from orders group by 1, 2),
g as (select o_custkey, unnest(generate_series(min(year), (select max(year) from y))) as year from y group by 1)
select o_custkey, cast(g.year as bigint) as year, cast(sum(coalesce(n, 0)) over w as bigint) as orders_to_date, cast(sum(coalesce(s, 0)) over w as double) as balance
from g left join y using (o_custkey, year) window w as (partition by o_custkey order by g.year)""")
def fact_snapshot(t: Tables) -> DataFrame:
    return loading.periodic_snapshot(t.orders, "o_custkey", "o_orderdate", "o_totalprice", 2)


@report("fact_snapshot_net", f"""with {NET_LINES},
y as (select l_suppkey, year(l_shipdate) as year, sum(net) as s, count(*) as n from net_lines group by 1, 2),
g as (select l_suppkey, unnest(generate_series(min(year), (select max(year) from y))) as year from y group by 1)
select l_suppkey, cast(g.year as bigint) as year, cast(sum(coalesce(n, 0)) over w as bigint) as orders_to_date, cast(sum(coalesce(s, 0)) over w as double) as balance
from g left join y using (l_suppkey, year) window w as (partition by l_suppkey order by g.year)""")
def fact_snapshot_net(t: Tables) -> DataFrame:
    return loading.periodic_snapshot(inputs.net_lines(t), "l_suppkey", "l_shipdate", "net", 4)


@report("fact_accumulating", """
with l as (select l_orderkey, cast(min(l_shipdate) as date) as first_ship, cast(max(l_shipdate) as date) as last_ship, count(*) as n from lineitem group by 1)
select o_orderkey, cast(o_orderdate as date) as ordered, first_ship, last_ship, coalesce(n, 0) as lines, date_diff('day', cast(o_orderdate as date), first_ship) as days_to_first,
  date_diff('day', first_ship, last_ship) as days_first_to_last from orders left join l on o_orderkey = l_orderkey""")
def fact_accumulating(t: Tables) -> DataFrame:
    return loading.accumulating_snapshot(t.orders, t.lineitem, "o_orderkey", "l_orderkey", "o_orderdate", "l_shipdate")


@report("split_by_type", "select event_type as typed_table, count(*) as num_rows, cast(sum(cast(value as decimal(18,2))) as double) as total from events group by 1")
def split_by_type(t: Tables) -> DataFrame:
    typed = loading.split_by_type(t.events, "event_type", fresh_path(t.spark, "typed_events"))
    parts = [df.agg(F.lit(name).alias("typed_table"), F.count(F.lit(1)).alias("num_rows"), v.exact_sum("value").alias("total")) for name, df in typed.items()]
    return reduce(DataFrame.unionByName, parts).where("num_rows > 0")
