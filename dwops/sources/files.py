"""Writing results: CSV, JSON lines and partitioned Parquet, and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dwops.functions.values import quarter_start


# Stands for a quoted empty field while reading; never part of a text.
EMPTY_MARK = "\u0000"


def write_csv(df: DataFrame, path: str) -> str:
    """Header line, NULL as an empty field, empty text as a quoted one."""
    df.write.mode("errorifexists").options(header=True, nullValue="", emptyValue='""', escape='"').csv(path)
    return path


def read_csv(spark: SparkSession, path: str, like: DataFrame, multi_line: bool = True) -> DataFrame:
    """Reads what ``write_csv`` wrote, line breaks inside fields included; each file is read
    whole, and there are as many as tasks that wrote. Without ``multi_line`` files are
    split, which only texts free of line breaks allow."""
    options = dict(header=True, nullValue="", emptyValue=EMPTY_MARK, escape='"', multiLine=multi_line)
    return spark.read.options(**options).schema(like.schema).csv(path).replace(EMPTY_MARK, "")


def write_json(df: DataFrame, path: str) -> str:
    """One JSON object per line."""
    df.write.mode("errorifexists").json(path)
    return path


def read_json(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return spark.read.schema(like.schema).json(path)


def write_partitioned(df: DataFrame, path: str, *columns: str) -> str:
    """One folder per value; the rebalance step keeps files even when one value dominates."""
    df.hint("rebalance", *columns).write.mode("errorifexists").partitionBy(*columns).parquet(path)
    return path


def range_bucket(column: str, unit: str) -> Column:
    if unit == "quarter":
        return quarter_start(column)
    return F.trunc(F.col(column).cast("date"), unit)


def partition_by_range(df: DataFrame, column: str, unit: str, path: str) -> str:
    """Date ranges of one ``unit`` each, in column ``part``."""
    return write_partitioned(df.withColumn("part", range_bucket(column, unit)), path, "part")


def list_bucket(column: str, groups: dict[str, list], default: str = "default") -> Column:
    expr = F.lit(default)
    for name, values in reversed(groups.items()):
        expr = F.when(F.col(column).isin(values), name).otherwise(expr)
    return expr


def partition_by_list(df: DataFrame, column: str, groups: dict[str, list], path: str) -> str:
    """Named value sets; anything else goes to ``default``."""
    return write_partitioned(df.withColumn("part", list_bucket(column, groups)), path, "part")


def hash_bucket(key: str, modulus: int) -> Column:
    return F.pmod(F.col(key), F.lit(modulus)).cast("long")


def partition_by_hash(df: DataFrame, key: str, modulus: int, path: str) -> str:
    """Integer keys by remainder."""
    return write_partitioned(df.withColumn("part", hash_bucket(key, modulus)), path, "part")


def scan_partitions(spark: SparkSession, path: str, column: str, lo, hi) -> DataFrame:
    """Read only the folders with ``lo <= column < hi``."""
    return spark.read.parquet(path).where((F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi)))
