"""Loading: merges, surrogate keys, incremental loads, audits, summaries and fact tables.

Spark cannot MERGE into plain Parquet; these return the next state of the table, to be
written to a new path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dwops.functions.values import amount_total, any_of
from dwops.operators.relational import not_exists_in
from dwops.plans.keyed import APART, apart, once_per_key
from dwops.plans.ordered import scan_groups
from dwops.sources.files import write_partitioned


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: dict[str, Column] | None = None,
           insert: dict[str, Column] | None = None) -> DataFrame:
    """MERGE: matched rows take the ``update`` columns, unmatched source rows are inserted.

    In ``update`` and ``insert`` the expressions see ``t`` (target row) and ``s`` (source
    row). By default all common columns come from the source; an empty dict changes
    nothing in matched rows, or leaves inserted columns NULL. A NULL in the source
    overwrites: presence is told by the row, not by its values. A key that comes twice in
    the source fails the job, as in MERGE; a key with a NULL in it matches nothing.
    """
    columns = target.columns
    common = [c for c in source.columns if c in columns]
    if update is None:
        update = {c: F.col(f"s.{c}") for c in common if c not in keys}
    if insert is None:
        insert = {c: F.col(f"s.{c}") for c in common}
    t = target.select(*keys, apart(target, keys), F.struct(*columns).alias("t"))
    both = t.join(once_per_key(source, keys, "s"), [*keys, APART], "full")
    types = target.schema
    matched, inserted = F.col("t").isNotNull() & F.col("s").isNotNull(), F.col("t").isNull()

    def value(c: str) -> Column:
        kind = types[c].dataType
        new = insert.get(c, F.lit(None)).cast(kind)
        old = F.col(f"t.{c}")
        return F.when(inserted, new).when(matched, update.get(c, old).cast(kind)).otherwise(old).alias(c)

    return both.select(*[value(c) for c in columns])


def scd1_merge(dim: DataFrame, stage: DataFrame, key: str) -> DataFrame:
    """Overwrite changed attributes, insert new members, keep the rest."""
    return upsert(dim, stage, [key])


def assign_keys(dim: DataFrame, stage: DataFrame, natural_key: str, surrogate: str) -> DataFrame:
    """Members unknown to the dimension, numbered on from its highest surrogate key.

    A member staged several times comes once, with its smallest row.
    """
    rest = [c for c in stage.columns if c != natural_key]
    unknown = not_exists_in(stage, dim.select(natural_key), natural_key)
    new = unknown.groupBy(natural_key).agg(F.min(F.struct(*rest)).alias("_row")).select(natural_key, "_row.*") if rest else unknown.distinct()
    new = new.select(*stage.columns)
    top = dim.agg(F.coalesce(F.max(surrogate), F.lit(0)).cast("long").alias("top"))
    return scan_groups(new, [], [natural_key], number="_n", derived=True).withColumn(surrogate, top.scalar() + F.col("_n")).drop("_n")


def incremental(source: DataFrame, control: DataFrame, table: str, ts: str) -> DataFrame:
    """Rows changed after the table's high-water mark; without a mark SQL's comparison gives none."""
    mark = control.where(F.col("table_name") == table).agg(F.max("load_date").alias("mark"))
    return source.where(F.col(ts) > mark.scalar())


def next_mark(loaded: DataFrame, control: DataFrame, table: str, ts: str) -> DataFrame:
    """The control row after a load: the highest loaded time, or the old mark when nothing came."""
    old = control.where(F.col("table_name") == table).agg(F.max("load_date").alias("mark")).scalar()
    return loaded.agg(
        F.lit(table).alias("table_name"), F.coalesce(F.max(ts), old).alias("load_date"), F.count(F.lit(1)).alias("loaded_rows")
    )


def audit_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """INSERT / UPDATE / DELETE entries between two snapshots, with both rows as JSON."""
    columns = old.columns
    o = old.select(F.col(key).alias("record_id"), F.struct(*columns).alias("o"))
    n = new.select(F.col(key).alias("record_id"), F.struct(*columns).alias("n"))
    both = o.join(n, "record_id", "full")
    differs = any_of([~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in columns])
    action = F.when(F.col("o").isNull(), "INSERT").when(F.col("n").isNull(), "DELETE").when(differs, "UPDATE")
    return (
        both.withColumn("action", action).where(F.col("action").isNotNull())
        .select("record_id", "action", F.to_json("o").alias("old_values"), F.to_json("n").alias("new_values"))
    )


def changed_rows(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """Added, removed and changed rows by the MD5 of a text column; only hashes are shuffled.

    NULL has no hash and differs from the empty text.
    """
    side = lambda df, name: df.select(key, F.md5(text).alias(f"{name}_hash"), F.lit(True).alias(f"_{name}"))
    status = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "changed")
    )
    both = side(old, "old").join(side(new, "new"), key, "full").withColumn("status", status)
    return both.where(F.col("status").isNotNull()).drop("_old", "_new")


# --- summaries -------------------------------------------------------------

def build_summary(df: DataFrame, keys: list, value: str, digits: int | None = None) -> DataFrame:
    """Partial aggregates per group that can be refreshed: count, sum, min, max; sums as in ``amount_total``.

    Give ``digits`` for doubles: sums of plain doubles depend on the order of the rows in their last bits.
    """
    total = amount_total(value, digits)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cnt"), (total if digits is None else total.cast(f"decimal(38,{digits})")).alias("total_amount"),
        F.min(value).alias("min_amount"), F.max(value).alias("max_amount"),
    )


def refresh_summary(summary: DataFrame, delta: DataFrame) -> DataFrame:
    """Merge the partials of new rows into a summary; equal to rebuilding it.

    Means are sum / count; distinct counts are kept as bitmaps beside it (``operators.distinct``).
    """
    keys = [c for c in summary.columns if c not in ("cnt", "total_amount", "min_amount", "max_amount")]
    return summary.unionByName(delta).groupBy(*keys).agg(
        F.sum("cnt").alias("cnt"), F.sum("total_amount").cast(summary.schema["total_amount"].dataType).alias("total_amount"),
        F.min("min_amount").alias("min_amount"), F.max("max_amount").alias("max_amount"),
    )


# --- fact tables -----------------------------------------------------------

def date_key(c: str) -> Column:
    """A date as the integer yyyymmdd."""
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("long")


def transaction_fact(df: DataFrame, keys: dict[str, Column], measures: list[str]) -> DataFrame:
    """One row per event with keys and measures only."""
    return df.select(*[c.alias(n) for n, c in keys.items()], *measures)


def periodic_snapshot(df: DataFrame, key: str, ts: str, value: str, digits: int | None = None) -> DataFrame:
    """Balance per key at each year's end, from the key's first year to the last year of the data; sums as in ``amount_total``.

    The calendar is unrolled per key from its own first year; a key has one row per year.
    """
    yearly = df.groupBy(key, F.year(ts).alias("year")).agg(amount_total(value, digits).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    last = df.agg(F.max(F.year(ts)).alias("y")).scalar()
    spans = yearly.groupBy(key).agg(F.min("year").alias("_first"))
    grid = spans.select(key, F.explode(F.sequence("_first", last)).alias("year"))
    w = Window.partitionBy(key).orderBy("year")
    return grid.join(yearly, [key, "year"], "left").select(
        key, F.col("year").cast("long").alias("year"),
        F.sum(F.coalesce("_n", F.lit(0))).over(w).alias("orders_to_date"),
        F.sum(F.coalesce("_sum", F.lit(0).cast(yearly.schema["_sum"].dataType))).over(w).cast("double").alias("balance"),
    )


def accumulating_snapshot(header: DataFrame, lines: DataFrame, key: str, line_key: str, ordered: str, shipped: str) -> DataFrame:
    """One row per lifecycle: ordered, first and last shipped, and the days between."""
    stages = lines.groupBy(F.col(line_key).alias(key)).agg(
        F.min(shipped).cast("date").alias("first_ship"), F.max(shipped).cast("date").alias("last_ship"),
        F.count(F.lit(1)).alias("lines"),
    )
    days = lambda a, b: F.date_diff(b, a).cast("long")
    return header.select(key, F.col(ordered).cast("date").alias("ordered")).join(stages, key, "left").withColumns({
        "lines": F.coalesce("lines", F.lit(0)),
        "days_to_first": days("ordered", "first_ship"),
        "days_first_to_last": days("first_ship", "last_ship"),
    })


def split_by_type(df: DataFrame, column: str, path: str, values: list[str] | None = None) -> dict[str, DataFrame]:
    """One table per type, without the type column, written in one pass and read one by one.

    All types of the data unless ``values`` names some; one folder each, so they are few.
    A NULL type comes under None.
    """
    typed = df.sparkSession.read.schema(df.schema).parquet(write_partitioned(df, path, column))
    if values is None:
        values = [r[0] for r in typed.select(column).distinct().orderBy(column).collect()]
    return {v: typed.where(F.col(column).eqNullSafe(F.lit(v))).drop(column) for v in values}
