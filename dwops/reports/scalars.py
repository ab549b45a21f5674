"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dwops.functions import values as v
from dwops.operators import loading
from dwops.reports import inputs
from dwops.reports.registry import Tables, report
from dwops.reports.sql import ORDERS_NULL


@report("concat_modes", f"with {ORDERS_NULL} select o_orderkey, o_orderstatus || '/' || o_orderpriority as strict, concat(o_orderstatus, '/', o_orderpriority) as skip_null from orders_null")
def concat_modes(t: Tables) -> DataFrame:
    parts = ("o_orderstatus", F.lit("/"), "o_orderpriority")
    return inputs.orders_null(t).select("o_orderkey", v.concat_strict(*parts).alias("strict"), v.concat_skip_null(*parts).alias("skip_null"))


@report("string_fns", "select p_partkey, upper(p_name) as up, lower(p_brand) as low, repeat('ab', p_size) as rep, repeat('  ', p_size - 1) || p_name as indented from part")
def string_fns(t: Tables) -> DataFrame:
    return t.part.select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"),
        F.repeat(F.lit("ab"), F.col("p_size")).alias("rep"), v.indent("p_name", "p_size").alias("indented"))


@report("date_add", """select o_orderkey, cast(o_orderdate as date) + 7 as plus_week, cast(cast(o_orderdate as date) - interval 1 month as date) as minus_month,
  cast(cast(o_orderdate as date) + interval 13 month as date) as plus_13_months, o_orderdate + interval 36 hours as plus_36h from orders""")
def date_add(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", v.add_days("o_orderdate", 7).alias("plus_week"), v.add_months("o_orderdate", -1).alias("minus_month"),
        v.add_months("o_orderdate", 13).alias("plus_13_months"), (F.col("o_orderdate") + F.expr("interval 36 hours")).alias("plus_36h"))


@report("date_diff_modes", """
with d as (select l_orderkey, l_linenumber, l_partkey, cast(o_orderdate as date) as a, cast(l_shipdate as date) as b from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, l_partkey, date_diff('day', a, b) as days, date_diff('year', a, b) as years,
  round(case when day(a) = day(b) or (a = last_day(a) and b = last_day(b)) then cast(12 * (year(b) - year(a)) + month(b) - month(a) as double)
       else 12 * (year(b) - year(a)) + month(b) - month(a) + (day(b) - day(a)) / 31.0::double end, 6) as months from d""")
def date_diff_modes(t: Tables) -> DataFrame:
    d = t("lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate").join(t("orders", "o_orderkey", "o_orderdate"), F.expr("l_orderkey = o_orderkey"))
    ends = ("o_orderdate", "l_shipdate")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", v.date_diff(*ends, "days").alias("days"), v.date_diff(*ends, "years").alias("years"),
                    F.round(v.date_diff(*ends, "months"), 6).alias("months"))


@report("date_format", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as iso_day, strftime(o_orderdate, '%d/%m/%Y %H:%M') as eu_minute from orders")
def date_format(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", v.fmt_date("o_orderdate").alias("iso_day"), v.fmt_date("o_orderdate", "dd/MM/yyyy HH:mm").alias("eu_minute"))


@report("date_parts", "select event_id, cast(date_trunc('month', ts) as date) as month, cast(year(ts) as bigint) as year, cast(hour(ts) as bigint) as hour, cast(floor(epoch(ts)) as bigint) as epoch_s from events")
def date_parts(t: Tables) -> DataFrame:
    return t.events.select("event_id", v.month_of("ts").alias("month"), v.year_of("ts").alias("year"), F.hour("ts").cast("long").alias("hour"), v.epoch_seconds("ts").alias("epoch_s"))


@report("json_extract", "select event_id, cast(props->>'$.k' as bigint) as k, props->>'$.missing' as missing from events")
def json_extract(t: Tables) -> DataFrame:
    return t.events.select("event_id", v.json_field("props", "$.k", "long").alias("k"), v.json_field("props", "$.missing").alias("missing"))


@report("json_contains", "select event_id, user_id from events where props->>'$.k' = '69'")
def json_contains(t: Tables) -> DataFrame:
    return t.events.where(v.json_contains("props", "$.k", 69)).select("event_id", "user_id")


@report("array_contains_all", """
with w as (select p_partkey, string_split(p_name, ' ') as words, p_brand from part)
select p_partkey, list_has_all(words, ['red', 'ring']) as has_both, list_contains(words, 'ring') as has_ring, array_to_string(list_append(words, 'new'), '|') as appended from w""")
def array_contains_all(t: Tables) -> DataFrame:
    words = t.part.select("p_partkey", F.split("p_name", " ").alias("words"))
    return words.select(
        "p_partkey", v.array_contains_all("words", ["red", "ring"]).alias("has_both"), F.array_contains("words", "ring").alias("has_ring"),
        F.array_join(v.array_append("words", "new"), "|").alias("appended"))


@report("split_rows", "select p_partkey, unnest(string_split(p_name, ' ')) as word from part")
def split_rows(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@report("snippet", "select doc_id, case when length(text) > 60 then substr(text, 1, 60) || '…' else text end as short_60, case when length(text) > 80 then substr(text, 1, 80) || '…' else text end as short_80 from documents")
def snippet(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", v.snippet("text", 60).alias("short_60"), v.snippet("text", 80).alias("short_80"))


NEW_DOCS = """new_docs as (select doc_id, case when lang = 'es' then text || ' (revised)' else text end as text from documents where source <> 'src3'
  union all select item_id + (select max(doc_id) + 1 from documents), text from benchmark)"""


@report("changed_rows", f"""
with {NEW_DOCS}
select * from (select coalesce(o.doc_id, n.doc_id) as doc_id, md5(o.text) as old_hash, md5(n.text) as new_hash,
  case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' when md5(o.text) <> md5(n.text) then 'changed' end as status
from documents o full join new_docs n on o.doc_id = n.doc_id) where status is not null""")
def changed_rows(t: Tables) -> DataFrame:
    docs = t("documents", "doc_id", "text", "lang", "source")
    revised = F.when(F.col("lang") == "es", F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    first_free = docs.agg(F.max("doc_id") + 1).scalar()
    new = docs.where("source <> 'src3'").select("doc_id", revised.alias("text")).unionByName(
        t.benchmark.select((F.col("item_id") + first_free).alias("doc_id"), "text"))
    return loading.changed_rows(docs, new, "doc_id", "text")


@report("row_json", f"with {ORDERS_NULL} select o_orderkey, cast(to_json({{'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus, 'o_orderpriority': o_orderpriority}}) as varchar) as row_json from orders_null")
def row_json(t: Tables) -> DataFrame:
    return inputs.orders_null(t).select("o_orderkey", v.row_json("o_orderkey", "o_orderstatus", "o_orderpriority", keep_null=True).alias("row_json"))


@report("date_series", """select c_custkey, unnest(generate_series(date_trunc('month', lo), hi, interval 1 month))::date as month
from (select o_custkey as c_custkey, min(o_orderdate) as lo, max(o_orderdate) as hi from orders group by 1)""")
def date_series(t: Tables) -> DataFrame:
    """Every month from a customer's first order to the last."""
    spans = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(v.month_of("o_orderdate")).alias("lo"), F.max("o_orderdate").alias("hi"))
    return spans.select("c_custkey", F.explode(v.date_series("lo", "hi", "1 month")).alias("month"))
