"""Reading tables: scans, samples, previews, counts and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from dwops.plans.ordered import sort_columns
from dwops.session import prepare


def load(spark: SparkSession, directory: str, name: str, *columns: str) -> DataFrame:
    """One Parquet table, optionally only some columns of it."""
    df = prepare(spark).read.parquet(f"{directory}/{name}.parquet")
    return df.select(*columns) if columns else df


def between_dates(df: DataFrame, column: str, lo: str, hi: str) -> DataFrame:
    """Half-open range on the bare column, so that it reaches the scan."""
    kind = df.schema[column].dataType
    return df.where((F.col(column) >= F.lit(lo).cast(kind)) & (F.col(column) < F.lit(hi).cast(kind)))


def sample_rows(df: DataFrame, n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows by the given order."""
    return df.orderBy(*sort_columns(order_by or df.columns[:1])).limit(n)


def sample_recent(df: DataFrame, ts: str, key: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.col(ts).desc_nulls_last(), F.col(key)).limit(n)


def sample_non_null(df: DataFrame, keys: list[str], n: int = 10, order_by: list[str] | None = None) -> DataFrame:
    return sample_rows(df.dropna(subset=keys), n, order_by)


def preview(df: DataFrame, limit: int = 100) -> DataFrame:
    """At most ``limit`` rows, each saying whether the preview is full (``truncated``).

    A result of exactly ``limit`` rows counts as truncated: nothing beyond it is read.
    """
    return df.limit(limit).withColumn("truncated", F.count(F.lit(1)).over(Window.partitionBy()) >= limit)


def count_only(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def partition_stats(df: DataFrame, bucket: Column, high: str) -> DataFrame:
    """Rows, lowest and highest value of ``high`` per bucket."""
    return df.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("num_rows"), F.min(high).alias("low_value"), F.max(high).alias("high_value")
    )


# Bytes of the fixed-width types.
FIXED_WIDTHS = [
    (T.BooleanType, 1), (T.IntegerType, 4), (T.DateType, 4), (T.LongType, 8), (T.DoubleType, 8),
    (T.TimestampType, 8), (T.TimestampNTZType, 8),
]


def row_length(df: DataFrame) -> Column:
    """Bytes of one row: text by its length, fixed-width values by their type, NULL as 0."""
    total = F.lit(0).cast("long")
    for field in df.schema:
        width = next((w for kind, w in FIXED_WIDTHS if isinstance(field.dataType, kind)), None)
        size = F.octet_length(F.col(field.name)) if width is None else F.lit(width)
        total = total + F.when(F.col(field.name).isNotNull(), size).otherwise(0)
    return total


def table_stats(df: DataFrame, table: str, ts: str | None = None) -> DataFrame:
    """Rows, average row length and last change, in one pass."""
    last = F.max(F.col(ts)) if ts else F.max(F.lit(None).cast("timestamp_ntz"))
    return df.agg(
        F.count(F.lit(1)).alias("num_rows"),
        (F.sum(row_length(df)) / F.count(F.lit(1))).alias("avg_row_len"),
        last.alias("last_change"),
    ).withColumn("table_name", F.lit(table))
