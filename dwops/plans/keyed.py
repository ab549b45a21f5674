"""Join helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dwops.functions.values import all_of, any_of


def join_on_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Null-safe join on equally named keys, keeping the left copy of them.

    Group keys may be NULL; ``USING`` would lose those groups.
    """
    names = {k: f"__{k}" for k in keys}
    renamed = right.withColumnsRenamed(names)
    condition: Column = all_of([left[k].eqNullSafe(renamed[names[k]]) for k in keys])
    return left.join(renamed, condition, how).drop(*names.values())


def with_group_values(df: DataFrame, keys: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Attach per-group aggregates to every row.

    Grouping combines on the map side and the join back is split by adaptive skew
    handling, so a group holding a third of all rows is never sorted in one task,
    which a window over the same keys would do.
    """
    if not keys:
        one = df.agg(*[c.alias(n) for n, c in aggs.items()])
        return df.select("*", *[one.select(n).scalar().alias(n) for n in aggs])
    grouped = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return join_on_same(df, grouped, list(keys), "left")


APART = "_apart"


def apart(df: DataFrame, keys: list[str]) -> Column:
    """A second join key that spreads rows without a complete key, which can match nothing, over all tasks."""
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.when(any_of([F.col(k).isNull() for k in keys]), F.xxhash64(*hashed)).otherwise(F.lit(0).cast("long")).alias(APART)


def once_per_key(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, _apart, the row as struct ``name``); a complete key that comes twice fails the job.

    Rows are laid out by key as a join on (keys, _apart) wants them, so the check adds no exchange to it.
    """
    complete = all_of([F.col(k).isNotNull() for k in keys])
    rows = df.select(*keys, apart(df, keys), F.struct(*df.columns).alias(name))
    twice = complete & (F.count(F.lit(1)).over(Window.partitionBy(*keys, APART)) > 1)
    # The check is part of the row that the caller uses, so that it is not optimised away.
    checked = F.when(F.col("_twice"), F.raise_error(F.lit("a key comes more than once in the source"))).otherwise(F.col(name))
    return rows.withColumn("_twice", twice).select(*keys, APART, checked.alias(name))


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores when the scan has fewer partitions than those.

    For costly work per row on a small file; a large table has more partitions than
    cores and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Cells (rows times what is made of each) that one task groups.
CELLS_PER_TASK = 2_000_000


def in_parts(df: DataFrame, cells: int) -> DataFrame:
    """Rows dealt out so that a task has about ``CELLS_PER_TASK`` cells, when a row becomes ``cells`` of them.

    For groupings of many cells a row: a task's hash table grows with the file split, which
    holds more rows the larger the file and the better it is compressed. The rows are counted first; equal ones
    meet in one task, where they are one group. Scans in smaller parts are left as they are.
    """
    parts = -(-df.count() * cells // CELLS_PER_TASK)
    return df.repartition(parts, F.xxhash64(*df.columns)) if parts > 1 and parts > df.rdd.getNumPartitions() else df
