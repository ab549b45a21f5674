"""Scans, samples, sinks, filters and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dwops.functions import values as v
from dwops.operators import quality, relational as rel
from dwops.reports import inputs
from dwops.reports.registry import Tables, report
from dwops.reports.sql import ORDERS_NULL
from dwops.session import fresh_path
from dwops.sources import files, tables as src


@report("scan_filter", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1997-01-01'")
def scan_filter(t: Tables) -> DataFrame:
    wanted = (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))
    return t.orders.where(wanted).select("o_orderkey", "o_totalprice")


@report("sample_head", "select * from customer order by c_custkey limit 10")
def sample_head(t: Tables) -> DataFrame:
    return src.sample_rows(t.customer, 10, ["c_custkey"])


@report("sample_recent", "select event_id, ts, user_id, event_type, value from events order by ts desc, event_id limit 10")
def sample_recent(t: Tables) -> DataFrame:
    return src.sample_recent(t("events", "event_id", "ts", "user_id", "event_type", "value"), "ts", "event_id", 10)


@report("sample_non_null", "select * from (select o_orderkey, nullif(o_orderstatus, 'P') as status from orders) "
                           "where status is not null order by o_orderkey limit 10")
def sample_non_null(t: Tables) -> DataFrame:
    keyed = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    return src.sample_non_null(keyed, ["status"], 10, ["o_orderkey"])


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


@report("bounded_preview", f"""
with head as (select {', '.join(LINE_ORDER)} from lineitem order by {', '.join(LINE_ORDER)} limit 100)
select *, (select count(*) >= 100 from head) as truncated from head""")
def bounded_preview(t: Tables) -> DataFrame:
    return src.preview(t("lineitem", *LINE_ORDER).orderBy(*LINE_ORDER), 100)


@report("count_only", "select count(*) as total_rows from orders join customer on o_custkey = c_custkey where c_acctbal > 5000")
def count_only(t: Tables) -> DataFrame:
    joined = t.orders.join(t.customer.where("c_acctbal > 5000"), F.col("o_custkey") == F.col("c_custkey"))
    return src.count_only(joined)


@report("csv_roundtrip", f"with {ORDERS_NULL} select * from orders_null")
def csv_roundtrip(t: Tables) -> DataFrame:
    df = inputs.orders_null(t)
    return files.read_csv(t.spark, files.write_csv(df, fresh_path(t.spark, "orders_csv")), df)


@report("json_roundtrip", "select n_nationkey, n_name, r_name, c_custkey, c_name from customer "
                          "join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def json_roundtrip(t: Tables) -> DataFrame:
    df = rel.star_join(t("customer", "c_custkey", "c_name", "c_nationkey"), [
        (t.nation, F.expr("c_nationkey = n_nationkey")), (t.region, F.expr("n_regionkey = r_regionkey")),
    ]).select("n_nationkey", "n_name", "r_name", "c_custkey", "c_name")
    return files.read_json(t.spark, files.write_json(df, fresh_path(t.spark, "customers_json")), df)


def _rows_per_part(t: Tables, path: str, kind: str) -> DataFrame:
    rows = t.spark.read.parquet(path).groupBy(F.col("part").cast(kind).alias("part"))
    return rows.agg(F.count(F.lit(1)).alias("num_rows"))


@report("partition_range", "select cast(date_trunc('quarter', o_orderdate) as date) as part, count(*) as num_rows from orders group by 1")
def partition_range(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "orders_by_quarter")
    return _rows_per_part(t, files.partition_by_range(t.orders, "o_orderdate", "quarter", path), "date")


SEGMENT_GROUPS = {"goods": ["MACHINERY", "FURNITURE"], "home": ["HOUSEHOLD", "BUILDING"]}


@report("partition_list", "select case when c_mktsegment in ('MACHINERY', 'FURNITURE') then 'goods' "
                          "when c_mktsegment in ('HOUSEHOLD', 'BUILDING') then 'home' else 'default' end as part, "
                          "count(*) as num_rows from customer group by 1")
def partition_list(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "customers_by_group")
    return _rows_per_part(t, files.partition_by_list(t.customer, "c_mktsegment", SEGMENT_GROUPS, path), "string")


@report("partition_hash", "select o_orderkey % 4 as part, count(*) as num_rows from orders group by 1")
def partition_hash(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "orders_by_hash")
    return _rows_per_part(t, files.partition_by_hash(t.orders, "o_orderkey", 4, path), "long")


@report("pruned_scan", "select o_orderkey, o_custkey, o_totalprice, cast(year(o_orderdate) as integer) as order_year "
                       "from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'")
def pruned_scan(t: Tables) -> DataFrame:
    by_year = t.orders.withColumn("order_year", F.year("o_orderdate"))
    path = files.write_partitioned(by_year, fresh_path(t.spark, "orders_by_year"), "order_year")
    return files.scan_partitions(t.spark, path, "order_year", 1996, 1997).select("o_orderkey", "o_custkey", "o_totalprice", "order_year")


@report("partition_stats", "select cast(year(l_shipdate) as bigint) as bucket, count(*) as num_rows, "
                           "min(l_shipdate) as low_value, max(l_shipdate) as high_value from lineitem group by 1")
def partition_stats(t: Tables) -> DataFrame:
    return src.partition_stats(t.lineitem, v.year_of("l_shipdate"), "l_shipdate")


@report("table_stats", """
select 'customer' as table_name, count(*) as num_rows,
  sum(cast(8 + strlen(c_name) + 4 + 8 + strlen(c_mktsegment) as bigint))::bigint / count(*) as avg_row_len, cast(null as timestamp) as last_change from customer
union all
select 'orders', count(*), sum(cast(8 + 8 + strlen(o_orderstatus) + 8 + 8 + strlen(o_orderpriority) as bigint))::bigint / count(*), max(o_orderdate) from orders
union all
select 'events', count(*), sum(cast(8 + 8 + 8 + strlen(event_type) + 8 + strlen(props) as bigint))::bigint / count(*), max(ts) from events""")
def table_stats(t: Tables) -> DataFrame:
    parts = [src.table_stats(t.customer, "customer"), src.table_stats(t.orders, "orders", "o_orderdate"),
             src.table_stats(t.events, "events", "ts")]
    return reduce(DataFrame.unionByName, parts)


# --- filters and predicates ------------------------------------------------

@report("cte_steps", """
with active as (select c_custkey, c_name, c_mktsegment from customer where c_acctbal > 0),
done as (select o_custkey, count(*) as order_count, sum(cast(o_totalprice as decimal(18,2))) as spent from orders where o_orderstatus = 'F' group by 1)
select c_name, c_mktsegment, coalesce(order_count, 0) as orders, coalesce(cast(spent as double), 0.0) as lifetime_value
from active left join done on c_custkey = o_custkey where coalesce(order_count, 0) > 0""")
def cte_steps(t: Tables) -> DataFrame:
    active = t.customer.where("c_acctbal > 0").select("c_custkey", "c_name", "c_mktsegment")
    done = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("orders"), v.exact_sum("o_totalprice").alias("lifetime_value")
    )
    out = rel.left_default(active, done, ["c_custkey"], {"orders": 0, "lifetime_value": 0.0})
    return out.where("orders > 0").drop("c_custkey").orderBy(F.desc("lifetime_value"))


@report("date_range", "select o_orderkey, o_orderdate from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-02-01'")
def date_range(t: Tables) -> DataFrame:
    return src.between_dates(t("orders", "o_orderkey", "o_orderdate"), "o_orderdate", "1996-01-01", "1996-02-01")


@report("case_flag", "select o_orderkey, case when o_totalprice < 100000 then 'small' when o_totalprice < 300000 then 'medium' else 'large' end as price_band, "
                     "case when o_orderstatus = 'F' then 1 else 0 end as is_done from orders")
def case_flag(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", v.band("o_totalprice", [(100000, "small"), (300000, "medium")], "large").alias("price_band"),
        v.flag_when(F.col("o_orderstatus") == "F").alias("is_done"),
    )


@report("safe_pct", """
select l_orderkey, cast(sum(case when l_returnflag = 'R' then l_quantity end) as double) as r_qty,
  coalesce(cast(sum(case when l_returnflag = 'A' then l_quantity end) as double), 0.0) as a_qty,
  round(100.0::double * sum(case when l_returnflag = 'R' then l_quantity end) / nullif(sum(case when l_returnflag = 'A' then l_quantity end), 0), 2) as r_over_a_pct
from lineitem group by 1""")
def safe_pct(t: Tables) -> DataFrame:
    quantity = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")))
    sums = t.lineitem.groupBy("l_orderkey").agg(quantity("R").alias("r_qty"), quantity("A").alias("a_qty"))
    return sums.withColumn("r_over_a_pct", v.pct("r_qty", "a_qty")).withColumn("a_qty", F.coalesce("a_qty", F.lit(0.0)))


@report("ci_match", "select c_custkey, lower(c_mktsegment) = 'building' as is_building, c_mktsegment ilike '%hold' as is_hold from customer "
                    "where lower(c_mktsegment) = 'building' or c_mktsegment ilike '%hold'")
def ci_match(t: Tables) -> DataFrame:
    flags = t.customer.select(
        "c_custkey", v.ci_equals("c_mktsegment", F.lit("Building")).alias("is_building"), v.ci_like("c_mktsegment", "%hold").alias("is_hold")
    )
    return flags.where("is_building or is_hold")


@report("regex_filter", r"select doc_id, source from documents where regexp_matches(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}')")
def regex_filter(t: Tables) -> DataFrame:
    return rel.regex_filter(t("documents", "doc_id", "source", "text"), "text", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}").select("doc_id", "source")


@report("soft_delete", "select c_custkey, c_name, c_mktsegment from customer where not (c_acctbal < 1000)")
def soft_delete(t: Tables) -> DataFrame:
    return rel.active_rows(inputs.cust_deleted(t)).select("c_custkey", "c_name", "c_mktsegment")


@report("pii_projection", "select c_custkey, c_nationkey, c_acctbal, c_mktsegment from customer")
def pii_projection(t: Tables) -> DataFrame:
    return rel.drop_pii(t.customer, ["c_name"])


@report("pii_aggregate", "select c_mktsegment, count(*) as num_rows, count(c_name) as c_name_count, count(distinct c_name) as c_name_distinct from customer group by 1")
def pii_aggregate(t: Tables) -> DataFrame:
    return rel.pii_aggregate(t.customer, ["c_mktsegment"], ["c_name"])


def _pii_sql() -> str:
    one = lambda table, kind, p: (
        f"select '{table}' as table_name, 'text' as \"column\", '{kind}' as kind, count(text) as \"values\", "
        f"count(*) filter (where regexp_matches(text, '{p}')) as hits, "
        f"round(100.0::double * count(*) filter (where regexp_matches(text, '{p}')) / nullif(count(text), 0), 2) as hit_pct from {table}"
    )
    return " union all ".join(one(t, k, p) for t in ("documents", "conversations") for k, p in quality.PII_PATTERNS.items())


@report("pii_scan", _pii_sql())
def pii_scan(t: Tables) -> DataFrame:
    return quality.pii_scan(t.documents, "documents", ["text"]).unionByName(
        quality.pii_scan(t.conversations, "conversations", ["text"])
    )


@report("distinct_keys", "select distinct o_custkey from orders where o_orderstatus = 'F'")
def distinct_keys(t: Tables) -> DataFrame:
    return rel.distinct_values(t.orders.where("o_orderstatus = 'F'"), ["o_custkey"])


@report("in_list", "select event_id, user_id, event_type from events where event_type in ('signup', 'purchase')")
def in_list(t: Tables) -> DataFrame:
    return rel.in_list(t("events", "event_id", "user_id", "event_type"), "event_type", ["signup", "purchase"])
