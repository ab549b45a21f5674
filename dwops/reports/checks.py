"""Profiles, constraints and result checks."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from dwops.operators import dependencies, quality
from dwops.reports import inputs
from dwops.reports.registry import Tables, report
from dwops.reports.sql import CUST_VERSIONS, ORDERS_NULL
from dwops.session import stored


def _profile_sql(source: str, columns: dict[str, str]) -> str:
    """Profile of each column by itself, as one would write it per column."""
    one = lambda c, kind: f"""select '{c}' as "column", '{kind}' as data_type, count(*) as total_rows, count(distinct {c}) as distinct_count, count(*) - count({c}) as null_count,
  coalesce(round(100.0::double * (count(*) - count({c})) / nullif(count(*), 0), 2), 0.0) as null_pct, cast(min({c}) as varchar) as min, cast(max({c}) as varchar) as max,
  (select string_agg(x || ':' || n, '|' order by n desc, x) from (select cast({c} as varchar) as x, count(*) as n from {source} where {c} is not null group by 1 order by n desc, x limit 5)) as top_values from {source}"""
    return " union all ".join(one(c, k) for c, k in columns.items())


ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
CUSTOMER_TYPES = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}


@report("profile_orders", f"with {ORDERS_NULL} {_profile_sql('orders_null', ORDER_TYPES)}")
def profile_orders(t: Tables) -> DataFrame:
    return quality.profile(inputs.orders_null(t))


@report("profile_customer", _profile_sql("customer", CUSTOMER_TYPES))
def profile_customer(t: Tables) -> DataFrame:
    return quality.profile(t.customer)


@report("check_unique", "select l_orderkey, l_linenumber, count(*) as copies from lineitem group by 1, 2 having count(*) > 1")
def check_unique(t: Tables) -> DataFrame:
    return quality.check_unique(t.lineitem, ["l_orderkey", "l_linenumber"])


@report("check_unique_where", f"with {CUST_VERSIONS} select o_custkey, count(*) as copies from cust_versions where valid_to is null or valid_from >= date '2000-01-01' group by 1 having count(*) > 1")
def check_unique_where(t: Tables) -> DataFrame:
    """A version table whose later versions are all marked current: customers with several."""
    broken = inputs.cust_versions(t).withColumn("is_current", F.col("is_current") | (F.col("valid_from") >= F.lit("2000-01-01").cast("date")))
    return quality.check_unique_where(broken, ["o_custkey"], F.col("is_current"))


@report("check_fk", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_mktsegment <> 'HOUSEHOLD')")
def check_fk(t: Tables) -> DataFrame:
    parent = t.customer.where("c_mktsegment <> 'HOUSEHOLD'")
    return quality.check_fk(t("orders", "o_orderkey", "o_custkey"), "o_custkey", parent, "c_custkey")


@report("delete_impact", """
with c as (select c_custkey from customer join nation on c_nationkey = n_nationkey where n_name = 'NATION_3'), o as (select o_orderkey from orders where o_custkey in (select c_custkey from c))
select 'nation' as table_name, count(*) as rows_deleted from nation where n_name = 'NATION_3' union all select 'customer', count(*) from c
union all select 'orders', count(*) from o union all select 'lineitem', count(*) from lineitem where l_orderkey in (select o_orderkey from o)""")
def delete_impact(t: Tables) -> DataFrame:
    return quality.delete_impact(t.nation.where("n_name = 'NATION_3'"), "nation", [
        ("customer", t.customer, "c_nationkey", "n_nationkey"), ("orders", t.orders, "o_custkey", "c_custkey"),
        ("lineitem", t.lineitem, "l_orderkey", "o_orderkey")])


@report("check_not_null", "with j as (select d.doc_id, l.quality, l.toxic from documents d left join labels l on d.doc_id = l.doc_id) "
                          "select 'doc_id' as \"column\", count(*) - count(doc_id) as null_rows from j union all select 'quality', count(*) - count(quality) from j union all select 'toxic', count(*) - count(toxic) from j")
def check_not_null(t: Tables) -> DataFrame:
    joined = t("documents", "doc_id").join(t.labels, "doc_id", "left")
    return quality.check_not_null(joined, ["doc_id", "quality", "toxic"])


@report("apply_defaults", "select d.doc_id, coalesce(l.quality, -1) as quality, coalesce(l.toxic, 0) as toxic from documents d left join labels l on d.doc_id = l.doc_id")
def apply_defaults(t: Tables) -> DataFrame:
    return quality.apply_defaults(t("documents", "doc_id").join(t.labels, "doc_id", "left"), {"quality": -1, "toxic": 0})


@report("check_rules", f"""with {ORDERS_NULL}, j as (select * from lineitem join orders_null on l_orderkey = o_orderkey)
select 'quantity_positive' as rule, count(*) as checked_rows, count(*) filter (where not l_quantity > 0) as violations from j
union all select 'ship_after_order', count(*), count(*) filter (where not l_shipdate >= o_orderdate) from j
union all select 'known_status', count(*), count(*) filter (where not o_orderstatus in ('F', 'O')) from j
union all select 'urgent_or_high', count(*), count(*) filter (where not o_orderpriority in ('1-URGENT', '2-HIGH', '3-MEDIUM')) from j""")
def check_rules(t: Tables) -> DataFrame:
    joined = t.lineitem.join(inputs.orders_null(t), F.expr("l_orderkey = o_orderkey"))
    return quality.check_rules(joined, {
        "quantity_positive": F.col("l_quantity") > 0, "ship_after_order": F.col("l_shipdate") >= F.col("o_orderdate"),
        "known_status": F.col("o_orderstatus").isin("F", "O"), "urgent_or_high": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM")})


@report("fd_partial", "select l_orderkey, count(distinct l_shipdate) as distinct_values from lineitem group by 1 having count(distinct l_shipdate) > 1")
def fd_partial(t: Tables) -> DataFrame:
    return quality.check_fd(t.lineitem, ["l_orderkey"], "l_shipdate")


FD_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@report("fd_matrix", " union all ".join(
    f"select '{a}' as determinant, '{b}' as dependent, count(distinct {a}) as singles, count(distinct ({a}, {b})) as pairs, count(distinct {a}) = count(distinct ({a}, {b})) as holds from part"
    for a in FD_COLUMNS for b in FD_COLUMNS if a != b))
def fd_matrix(t: Tables) -> DataFrame:
    return quality.find_fds(t.part, FD_COLUMNS)


FLAT_COLUMNS = ["c_custkey", "c_mktsegment", "n_nationkey", "n_name", "n_regionkey", "r_name"]
_SETS = [s for n in range(1, 5) for s in combinations(FLAT_COLUMNS, n)]
# Distinct values of every set of up to four columns; the rest is set algebra over that list.
LATTICE_SQL = f"""with flat as (select {', '.join(FLAT_COLUMNS)} from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
sizes as ({' union all '.join(f"select [{', '.join(repr(c) for c in s)}] as cols, count(distinct ({', '.join(s)}, 0)) as n from flat" for s in _SETS)}),
keys as (select cols from sizes where n = (select count(*) from flat) and not exists (
  select 1 from sizes k where len(k.cols) < len(sizes.cols) and list_has_all(sizes.cols, k.cols) and k.n = (select count(*) from flat))),
fds as (select x.cols as lhs, list_filter(y.cols, lambda c: not list_contains(x.cols, c))[1] as rhs from sizes x join sizes y
  on len(x.cols) <= 3 and len(y.cols) = len(x.cols) + 1 and list_has_all(y.cols, x.cols) and x.n = y.n),
minimal as (select * from fds where not exists (select 1 from fds f where f.rhs = fds.rhs and len(f.lhs) < len(fds.lhs) and list_has_all(fds.lhs, f.lhs)))
select array_to_string(list_sort(lhs), ',') as determinant, rhs as dependent,
  case when exists (select 1 from keys where list_has_all(cols, lhs) and len(cols) = len(lhs)) then 'key' when exists (select 1 from keys where list_contains(cols, rhs)) then 'prime'
    when exists (select 1 from keys where list_has_all(cols, lhs)) then 'partial' else 'transitive' end as kind from minimal"""


@report("fd_lattice", LATTICE_SQL)
def fd_lattice(t: Tables) -> DataFrame:
    """Minimal dependencies of the flat customer table: customer -> nation -> region is transitive."""
    flat = t("customer", "c_custkey", "c_mktsegment", "c_nationkey").join(t.nation, F.expr("c_nationkey = n_nationkey")).join(t.region, F.expr("n_regionkey = r_regionkey"))
    return dependencies.find_dependencies(flat, FLAT_COLUMNS)


@report("decompose", """
with flat as (select c_custkey, n_nationkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select 'flat' as part, count(*) as num_rows from flat union all select 'base', count(*) from flat
union all select 'lookup', count(*) from (select distinct n_nationkey, n_name, r_name from flat) union all select 'rejoined_equal', count(*) from flat""")
def decompose(t: Tables) -> DataFrame:
    flat = t("customer", "c_custkey", "c_nationkey").join(t.nation, F.expr("c_nationkey = n_nationkey")).join(t.region, F.expr("n_regionkey = r_regionkey")).select(
        "c_custkey", "n_nationkey", "n_name", "r_name")
    flat = stored(flat)  # counted and compared below
    base, lookup = quality.decompose(flat, ["n_nationkey"], ["n_name", "r_name"])
    back = base.join(lookup, "n_nationkey").select(*flat.columns).intersect(flat)
    sizes = {"flat": flat, "base": base, "lookup": lookup, "rejoined_equal": back}
    return reduce(DataFrame.unionByName, [df.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("num_rows")) for n, df in sizes.items()])


@report("all_null_columns", "with j as (select o_orderkey, max(nullif(o_orderpriority, o_orderpriority)) over () as never, l_shipdate as late from orders left join lineitem on o_orderkey = l_orderkey and l_shipdate > timestamp '2100-01-01') "
                            "select 'never' as \"column\", count(*) as rows from j union all select 'late', count(*) from j")
def all_null_columns(t: Tables) -> DataFrame:
    """One wrong column and one right column met by a join that finds nothing."""
    late = t("lineitem", "l_orderkey", F.col("l_shipdate").alias("late")).where("late > timestamp_ntz '2100-01-01'")
    never = F.nullif("o_orderpriority", "o_orderpriority").alias("never")
    joined = t.orders.select("o_orderkey", never).join(late, F.expr("o_orderkey = l_orderkey"), "left").drop("l_orderkey")
    return quality.all_null_columns(joined)


@report("check_result", f"""with {ORDERS_NULL} select 'row_count' as "check", count(*) as found, count(*) between 1 and 1000000000 as passed from orders_null
union all select 'not_null:o_orderkey', count(*) - count(o_orderkey), count(*) = count(o_orderkey) from orders_null
union all select 'not_null:o_orderpriority', count(*) - count(o_orderpriority), count(*) = count(o_orderpriority) from orders_null""")
def check_result(t: Tables) -> DataFrame:
    return quality.check_result(inputs.orders_null(t), 1, 1_000_000_000, ["o_orderkey", "o_orderpriority"])


@report("probe_stages", """
with s1 as (select * from orders where o_orderdate >= timestamp '1996-01-01'), s2 as (select s1.*, c_name from s1 join customer on o_custkey = c_custkey),
s3 as (select * from s2 where o_orderstatus = 'f'), s4 as (select o_custkey, c_name, count(*) as n from s3 group by 1, 2)
select cast(1 as bigint) as step, 'recent_orders' as stage, count(*) as rows, cast(null as bigint) as c_name_non_null, false as at_fault from s1
union all select 2, 'with_customer', count(*), count(c_name), false from s2 union all select 3, 'only_done', count(*), count(c_name), true from s3
union all select 4, 'per_customer', count(*), count(c_name), false from s4""")
def probe_stages(t: Tables) -> DataFrame:
    """A four-step query whose third step filters on the wrong case."""
    s1 = t.orders.where("o_orderdate >= timestamp_ntz '1996-01-01'")
    s2 = s1.join(t("customer", "c_custkey", "c_name"), F.expr("o_custkey = c_custkey"))
    s3 = s2.where("o_orderstatus = 'f'")
    s4 = s3.groupBy("o_custkey", "c_name").agg(F.count(F.lit(1)).alias("n"))
    stages = [("recent_orders", s1), ("with_customer", s2), ("only_done", s3), ("per_customer", s4)]
    return quality.probe_stages(stages, ["c_name"])


FOREIGN_KEYS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
                ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
                ("nation", "n_regionkey", "region", "r_regionkey"), ("documents", "doc_id", "labels", "doc_id")]


def _verify_sql(a: str, ak: str, b: str, bk: str) -> str:
    return f"""select '{a}.{ak} = {b}.{bk}' as join_name, (select count(*) from {a} x join {b} y on x.{ak} = y.{bk}) as joined_rows, count(*) as left_rows,
  count(*) filter (where m) as left_matched, count(*) filter (where not m) as left_orphans, (select count(*) from {b} y where not exists (select 1 from {a} x where x.{ak} = y.{bk})) as right_orphans,
  (select max(n) from (select count(*) as n from {b} y where exists (select 1 from {a} x where x.{ak} = y.{bk}) group by y.{bk})) as max_fan_out,
  round(100.0::double * count(*) filter (where m) / nullif(count(*), 0), 2) as match_pct, count(*) filter (where m) > 0 as verified
from (select exists (select 1 from {b} y where x.{ak} = y.{bk}) as m from {a} x)"""


@report("verify_join", " union all ".join(_verify_sql(*fk) for fk in FOREIGN_KEYS))
def verify_join(t: Tables) -> DataFrame:
    parts = [quality.verify_join(t(a, ak), ak, t(b, bk), bk, f"{a}.{ak} = {b}.{bk}") for a, ak, b, bk in FOREIGN_KEYS]
    return reduce(DataFrame.unionByName, parts)


@report("dead_ratio", "select c_nationkey, count(*) filter (where c_acctbal < 1000) as dead_rows, count(*) filter (where not c_acctbal < 1000) as live_rows, "
                      "round(100.0::double * count(*) filter (where c_acctbal < 1000) / nullif(count(*), 0), 2) as dead_pct from customer group by 1")
def dead_ratio(t: Tables) -> DataFrame:
    return quality.dead_ratio(inputs.cust_deleted(t), ["c_nationkey"], F.col("deleted_at").isNotNull())
