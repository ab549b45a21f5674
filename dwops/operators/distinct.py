"""Exact distinct counts that can be merged and rolled up: bitmaps of ids.

A distinct count cannot be added up, the set behind it can. Ids of a group are kept as words
of 64 bits, one row per group and range of 64 ids, so that new rows are merged with a bitwise
OR, coarser groups come from finer ones, and counting is adding up set bits. A group of any
size is spread over its words; a word is a long, so every step combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dwops.plans.keyed import join_on_same

WORD, BITS = "word", "bits"


def id_bits(df: DataFrame, keys: list[str | Column], column: str) -> DataFrame:
    """(keys, word, bits): the distinct values of an integer column per group; NULLs are left out.

    Negative values are fine. Values that are no integers need keys first (``assign_keys``).
    """
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{column} is {kind.simpleString()}: only integers have a place in a bitmap")
    value = F.col(column).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), value.bitwiseAND(63).cast("int"))
    placed = df.where(value.isNotNull()).withColumns({f"_{BITS}": bit, f"_{WORD}": F.shiftright(value, 6)})
    return placed.groupBy(*keys, F.col(f"_{WORD}").alias(WORD)).agg(F.bit_or(f"_{BITS}").alias(BITS))


def _keys(bits: DataFrame) -> list[str]:
    return [c for c in bits.columns if c not in (WORD, BITS)]


def merge_bits(bits: DataFrame, delta: DataFrame) -> DataFrame:
    """Both sets in one: what ``id_bits`` gives for all rows behind them, in any order and with repeats."""
    return bits.unionByName(delta).groupBy(*_keys(bits), WORD).agg(F.bit_or(BITS).alias(BITS))


def roll_up_bits(bits: DataFrame, keys: list[str | Column]) -> DataFrame:
    """The sets of coarser groups: ``keys`` are columns of ``bits`` or expressions over them."""
    return bits.groupBy(*keys, WORD).agg(F.bit_or(BITS).alias(BITS))


def count_bits(bits: DataFrame, name: str = "distinct_count") -> DataFrame:
    """(keys, count of distinct values); groups of NULLs alone have no row."""
    return bits.groupBy(*_keys(bits)).agg(F.sum(F.bit_count(BITS)).cast("long").alias(name))


def shared_bits(bits: DataFrame, other: DataFrame, name: str = "shared_count") -> DataFrame:
    """(keys, count of values that both sets of a group hold); groups of one side alone count 0."""
    keys = _keys(bits)
    sides = bits.select(*keys, WORD, F.col(BITS).alias("_a"), F.lit(None).cast("long").alias("_b")).unionByName(
        other.select(*keys, WORD, F.lit(None).cast("long").alias("_a"), F.col(BITS).alias("_b")))
    words = sides.groupBy(*keys, WORD).agg(F.bit_or("_a").alias("_a"), F.bit_or("_b").alias("_b"))
    common = F.bit_count(F.coalesce(F.col("_a").bitwiseAND(F.col("_b")), F.lit(0).cast("long")))
    return words.groupBy(*keys).agg(F.sum(common).cast("long").alias(name))


def with_distinct(summary: DataFrame, bits: DataFrame, name: str) -> DataFrame:
    """A summary with the distinct counts of its groups beside it; 0 where a group has only NULLs."""
    joined = join_on_same(summary, count_bits(bits, name), _keys(bits), "left")
    return joined.withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
