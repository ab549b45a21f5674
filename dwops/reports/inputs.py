"""Derived inputs: tables that Spark derives from the given ones to exercise an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dwops.operators.temporal import scd2_from_changes
from dwops.reports.registry import Tables


def orders_null(t: Tables) -> DataFrame:
    """Orders whose low priority is NULL."""
    return t.orders.withColumn("o_orderpriority", F.nullif("o_orderpriority", F.lit("5-LOW")))


def cust_stage(t: Tables) -> DataFrame:
    """Staged load: a new segment for one segment's customers, and suppliers as new customers."""
    changed = t.customer.where("c_mktsegment = 'BUILDING'").withColumn("c_mktsegment", F.lit("UPDATED"))
    first_free = t.customer.agg(F.max("c_custkey") + 1).scalar()
    new = t.supplier.select(
        (F.col("s_suppkey") + first_free).alias("c_custkey"), F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"),
    )
    return changed.unionByName(new)


def cust_versions(t: Tables) -> DataFrame:
    """Priority of each customer over time."""
    log = t("orders", "o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("priority"))
    log = log.withColumn("day", F.col("o_orderdate").cast("date"))
    return scd2_from_changes(log, "o_custkey", "day", ["priority"], "o_orderkey")


def part_new(t: Tables) -> DataFrame:
    """Later part snapshot: some rows gone, one brand resized, suppliers' own parts added."""
    kept = t.part.where("not (p_type = 'PROMO' and p_size >= 45)").withColumn(
        "p_size", F.when(F.col("p_brand") == "Brand#2", F.col("p_size") + 1).otherwise(F.col("p_size"))
    )
    first_free = t.part.agg(F.max("p_partkey") + 1).scalar()
    new = t.supplier.select(
        (F.col("s_suppkey") + first_free).alias("p_partkey"), F.col("s_name").alias("p_name"), F.lit("Brand#99").alias("p_brand"),
        F.lit("NEW").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1000.0).alias("p_retailprice"),
    )
    return kept.unionByName(new)


def part_tree(t: Tables) -> DataFrame:
    """Parts as a tree: the parent of part k is part k div 10, part 0 is the root."""
    return t.part.select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.expr("p_partkey div 10")).alias("parent"),
        F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"),
    )


def bom(t: Tables) -> DataFrame:
    """Parts list: part k div 3 contains 1 + k % 3 pieces of part k."""
    return t.part.where("p_partkey > 0").select(
        F.expr("p_partkey div 3").alias("part_id"), F.col("p_partkey").alias("component_id"),
        (F.lit(1) + F.col("p_partkey") % 3).alias("quantity"),
    )


def etl_control(t: Tables) -> DataFrame:
    """High-water mark of the orders table: a year before the last order."""
    return t.orders.agg(F.max("o_orderdate").alias("m")).select(
        F.lit("orders").alias("table_name"), (F.col("m") - F.expr("interval 365 days")).alias("load_date")
    )


def bookings(t: Tables) -> DataFrame:
    """Each order as a 30-day booking of its customer."""
    start = F.col("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", "o_custkey", start.alias("start_day"), F.date_add(start, 30).alias("end_day"))


def cust_deleted(t: Tables) -> DataFrame:
    """Customers with a low balance are soft-deleted."""
    gone = F.when(F.col("c_acctbal") < 1000, F.lit("2001-01-01").cast("timestamp_ntz"))
    return t.customer.withColumn("deleted_at", gone)


def lineage_edges(t: Tables) -> dict[str, DataFrame]:
    """Supplier -> part -> order -> customer."""
    edge = lambda df, src, a, dst, b: df.select(
        F.concat(F.lit(src), F.col(a).cast("string")).alias("src"), F.concat(F.lit(dst), F.col(b).cast("string")).alias("dst")
    )
    return {
        "order_customer": edge(t.orders, "o:", "o_orderkey", "c:", "o_custkey"),
        "part_order": edge(t.lineitem, "p:", "l_partkey", "o:", "l_orderkey"),
        "supplier_part": edge(t.lineitem, "s:", "l_suppkey", "p:", "l_partkey"),
    }


def daily_revenue(t: Tables) -> DataFrame:
    """One row per day: exact revenue."""
    return t.orders.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("revenue")
    )


def net_lines(t: Tables) -> DataFrame:
    """Order lines with their discounted price, which has four decimals."""
    lines = t("lineitem", "l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_discount")
    return lines.withColumn("net", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4)).drop("l_extendedprice", "l_discount")
