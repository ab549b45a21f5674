"""Pieces of SQL that several reports share (the derived inputs, in DuckDB's dialect)."""

REVENUE = "cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))"

ORDERS_NULL = """orders_null as (
  select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
         nullif(o_orderpriority, '5-LOW') as o_orderpriority from orders)"""

CUST_STAGE = """cust_stage as (
  select c_custkey, c_name, c_nationkey, c_acctbal, 'UPDATED' as c_mktsegment from customer where c_mktsegment = 'BUILDING'
  union all
  select s_suppkey + (select max(c_custkey) + 1 from customer), s_name, s_nationkey, s_acctbal, 'NEW' from supplier)"""

CUST_VERSIONS = """days as (
  select o_custkey, cast(o_orderdate as date) as valid_from, arg_max(o_orderpriority, o_orderkey) as priority
  from orders group by 1, 2),
changed as (
  select * from (select *, lag(priority) over (partition by o_custkey order by valid_from) as before from days)
  where before is distinct from priority),
cust_versions as (
  select o_custkey, priority, valid_from, lead(valid_from) over (partition by o_custkey order by valid_from) as valid_to from changed)"""

PART_NEW = """part_new as (
  select p_partkey, p_name, p_brand, p_type, case when p_brand = 'Brand#2' then p_size + 1 else p_size end as p_size, p_retailprice
  from part where not (p_type = 'PROMO' and p_size >= 45)
  union all
  select s_suppkey + (select max(p_partkey) + 1 from part), s_name, 'Brand#99', 'NEW', 1, 1000.0 from supplier)"""

PART_TREE = """part_tree as (
  select p_partkey as id, case when p_partkey > 0 then p_partkey // 10 end as parent, p_name as name, p_retailprice as price
  from part)"""

DAILY = """daily as (
  select cast(o_orderdate as date) as day, sum(cast(o_totalprice as decimal(18,2))) as revenue from orders group by 1)"""

NET_LINES = f"""net_lines as (select l_orderkey, l_suppkey, l_shipdate, {REVENUE} as net from lineitem)"""
