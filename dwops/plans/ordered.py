"""Ordered computations (row numbers, running sums, frames, ranks) over groups of any size.

A window sorts each group inside one task. That is right for small groups and wrong
for a group with a third of a 100 TB table, or for no partition key at all. Here the
groups larger than ``spark.dwops.chunkRows`` are found first; when there are none, the
plain window runs. Otherwise the rows of the large groups are range-partitioned by group
and order into chunks of about that many rows and stored with their chunk number. Windows
run per (group, chunk), and what precedes a chunk (row count, sum, last value) is carried
in from one row per chunk. The results are exact, wherever the chunks begin.

Storing the chunk numbers fixes them: a task that is run again cannot move a row to
another chunk. Collected to the driver is one row per large group, so at most total rows /
chunk rows of them.

Order columns are names, a leading ``-`` meaning descending; NULLs sort first.

Two remarks callers can make: ``bounded`` says that groups are known to be small (one
row per day, say, or because ``all_small`` has looked), so nothing is counted; ``derived``
says that the input is costly to compute, so it is stored first, which also tells its number
of rows: if that is small no group can be large, and groups need not be counted either.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from dwops.functions.values import micros
from dwops.plans.keyed import join_on_same
from dwops.session import stored, stored_counted

CHUNK_ROWS_KEY = "spark.dwops.chunkRows"
DEFAULT_CHUNK_ROWS = 5_000_000


def chunk_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(CHUNK_ROWS_KEY, str(DEFAULT_CHUNK_ROWS)))


def sort_columns(order: list[str]) -> list[Column]:
    return [F.col(o[1:]).desc_nulls_first() if o.startswith("-") else F.col(o).asc_nulls_first() for o in order]


def large_groups(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """Keys and sizes of the groups with more than ``rows`` rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)


def all_small(df: DataFrame, keys: list[str], rows: int | None = None) -> bool:
    """Whether no group is large: one pass that several steps over the same groups can share."""
    return large_groups(df, list(keys), rows or chunk_rows(df)).isEmpty()


@dataclass
class Chunked:
    df: DataFrame             # the input, plus ``_chunk`` when some group was cut
    keys: list[str]
    order: list[str]
    cut: DataFrame | None     # the stored rows of the groups that were cut
    rest: DataFrame | None    # the rows of the other groups, when there can be any

    @property
    def window(self) -> WindowSpec:
        parts = self.keys if self.cut is None else [*self.keys, "_chunk"]
        return Window.partitionBy(*parts).orderBy(*sort_columns(self.order))


def chunked(df: DataFrame, keys: list[str], order: list[str], rows: int | None = None, *, bounded: bool = False,
            derived: bool = False) -> Chunked:
    """Cut the groups with more than ``rows`` rows into ordered chunks."""
    keys, rows = list(keys), rows or chunk_rows(df)
    if derived and not bounded:
        df, found = stored_counted(df)
        bounded = found <= rows
    large = [] if bounded else large_groups(df, keys, rows).collect()
    if not large:
        return Chunked(df, keys, order, None, df)
    many, rest = df, None
    if keys:
        listed = df.sparkSession.createDataFrame([tuple(r[k] for k in keys) for r in large], df.select(*keys).schema)
        many = join_on_same(df, F.broadcast(listed), keys, "left_semi")
        rest = join_on_same(df, F.broadcast(listed), keys, "left_anti")
    chunks = ceil(sum(r["_n"] for r in large) / rows)
    ranged = many.repartitionByRange(chunks, *[F.col(k) for k in keys], *sort_columns(order))
    cut = stored(ranged.withColumn("_chunk", F.spark_partition_id()))
    together = cut if rest is None else rest.withColumn("_chunk", F.lit(0)).unionByName(cut)
    return Chunked(together, keys, order, cut, rest)


def _place(df: DataFrame, order: list[str]) -> Column | None:
    """The order values as one ascending struct; descending ones enter negated, None if one cannot."""
    parts = []
    for i, o in enumerate(order):
        name = o.lstrip("-")
        kind, value = df.schema[name].dataType, F.col(name)
        if o.startswith("-"):
            if isinstance(kind, T.NumericType):
                value = -value
            elif isinstance(kind, T.DateType):
                value = -F.unix_date(value)
            elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                value = -micros(value)
            else:
                return None
        parts.append(value.alias(f"o{i}"))
    return F.struct(*parts)


def _scan(c: Chunked, number: str | None, sums: dict[str, Column], last: dict[str, Column],
          highest: dict[str, Column] | None = None, lowest: dict[str, Column] | None = None) -> DataFrame:
    upto = c.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    columns = {n: F.sum(v).over(upto) for n, v in sums.items()}
    # name -> (aggregate over rows, the same of two values, what it is taken of)
    extremes = {n: (F.max, F.greatest, v) for n, v in (highest or {}).items()} | {n: (F.min, F.least, v) for n, v in (lowest or {}).items()}
    columns |= {n: of_rows(v).over(upto) for n, (of_rows, _, v) in extremes.items()}
    columns |= {n: F.last(v, ignorenulls=True).over(upto) for n, v in last.items()}
    if number:
        columns[number] = F.row_number().over(c.window).cast("long")
    local = c.df.withColumns(columns)
    if c.cut is None:
        return local

    kinds = local.schema
    # The place of a row within its chunk; an order that no value can stand for is numbered.
    cut, place = c.cut, _place(c.cut, c.order) if last else None
    if last and place is None:
        cut, place = cut.withColumn("_nth", F.row_number().over(c.window)), F.col("_nth")
    per_chunk = cut.groupBy(*c.keys, "_chunk").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(v).alias(f"_sum_{n}") for n, v in sums.items()],
        *[F.max_by(v, F.when(v.isNotNull(), place)).alias(f"_last_{n}") for n, v in last.items()],
        *[of_rows(v).alias(f"_far_{n}") for n, (of_rows, _, v) in extremes.items()],
    )
    before = Window.partitionBy(*c.keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(
        *c.keys,
        "_chunk",
        F.sum("_rows").over(before).alias("_rows"),
        *[F.sum(f"_sum_{n}").over(before).alias(f"_sum_{n}") for n in sums],
        *[F.last(f"_last_{n}", ignorenulls=True).over(before).alias(f"_last_{n}") for n in last],
        *[of_rows(f"_far_{n}").over(before).alias(f"_far_{n}") for n, (of_rows, _, _) in extremes.items()],
    )
    # One row per chunk and large group in it: at most twice total rows / chunk rows.
    joined = join_on_same(local, F.broadcast(carried), [*c.keys, "_chunk"], "left")
    final = {n: F.coalesce(F.col(n) + F.col(f"_sum_{n}"), F.col(n), F.col(f"_sum_{n}")).cast(kinds[n].dataType) for n in sums}
    final |= {n: F.coalesce(F.col(n), F.col(f"_last_{n}")) for n in last}
    final |= {n: of_two(F.col(n), F.col(f"_far_{n}")) for n, (_, of_two, _) in extremes.items()}
    if number:
        final[number] = F.col(number) + F.coalesce(F.col("_rows"), F.lit(0))
    return joined.withColumns(final).drop(
        "_chunk", "_rows", *[f"_sum_{n}" for n in sums], *[f"_last_{n}" for n in last], *[f"_far_{n}" for n in extremes]
    )


def scan_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    number: str | None = None,
    sums: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    highest: dict[str, Column] | None = None,
    lowest: dict[str, Column] | None = None,
    rows: int | None = None,
    **remarks: bool,
) -> DataFrame:
    """Add, per group in order: a row number, running sums over rows, last non-NULL values and extremes so far.

    The order must be unique within a group for the result to be determined.
    """
    return _scan(chunked(df, keys, order, rows, **remarks), number, sums or {}, last or {}, highest, lowest)


def row_frames(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    before: int,
    after: int,
    columns: dict[str, Callable],
    rows: int | None = None,
    **remarks: bool,
) -> DataFrame:
    """Window columns that look at most ``before`` rows back and ``after`` rows ahead.

    ``columns`` maps a name to a function from an ordered window to a column. Large
    groups are numbered and laid out in blocks of consecutive rows; the few rows a
    neighbouring block needs are copied to it, and dropped again afterwards.
    """
    size = max(rows or chunk_rows(df), before + after + 1)
    c = chunked(df, keys, order, size, **remarks)
    plain = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    small = None if c.rest is None else c.rest.withColumns({n: make(plain) for n, make in columns.items()})
    if c.cut is None:
        return small
    numbered = _scan(replace(c, df=c.cut), "_rn", {}, {}).withColumn("_i", F.col("_rn") - 1)
    first = F.expr(f"greatest(_i - {after}, 0) div {size}")
    final = F.expr(f"(_i + {before}) div {size}")
    blocks = numbered.withColumn("_block", F.explode(F.sequence(first, final)))
    window = Window.partitionBy(*keys, "_block").orderBy("_rn")
    computed = blocks.withColumns({n: make(window) for n, make in columns.items()})
    large = computed.where(F.expr(f"_block = _i div {size}")).drop("_rn", "_i", "_block")
    return large if small is None else small.unionByName(large)


def previous_value(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, Column],
                   rows: int | None = None, **remarks: bool) -> DataFrame:
    """LAG(value, 1) for several columns."""
    lags = {n: (lambda w, v=v: F.lag(v).over(w)) for n, v in columns.items()}
    return row_frames(df, keys, order, 1, 0, lags, rows, **remarks)


def rank_values(df: DataFrame, keys: list[str], value: str, rows: int | None = None, *, bounded: bool = False) -> DataFrame:
    """Add per row, for the position of ``value`` in its group (``-value`` = descending):

    ``_rank``, ``_dense``, ``_upto`` (rows at or before it) and ``_total`` (rows in the group).

    With a large group, ties are first grouped to one row each, so a value held by a
    third of all rows costs one row in the ordered part.
    """
    keys, name, limit = list(keys), value.lstrip("-"), rows or chunk_rows(df)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    if bounded or sizes.where(F.col("_total") > limit).isEmpty():
        ordered = Window.partitionBy(*keys).orderBy(*sort_columns([value]))
        return df.withColumns({
            "_rank": F.rank().over(ordered).cast("long"),
            "_dense": F.dense_rank().over(ordered).cast("long"),
            "_upto": F.count(F.lit(1)).over(ordered),
            "_total": F.count(F.lit(1)).over(Window.partitionBy(*keys)),
        })
    counts = df.groupBy(*keys, name).agg(F.count(F.lit(1)).alias("_ties"))
    places = scan_groups(counts, keys, [value], number="_dense", sums={"_upto": F.col("_ties")}, rows=limit, derived=True)
    places = places.withColumn("_rank", F.col("_upto") - F.col("_ties") + 1)
    placed = join_on_same(df, places.drop("_ties"), [*keys, name], "left")
    if keys:
        return join_on_same(placed, sizes, keys, "left")
    return placed.withColumn("_total", sizes.scalar())


def ntile_from_number(number: Column, total: Column, n: int) -> Column:
    """NTILE bucket from a row number: the first ``total % n`` buckets hold one row more."""
    small, extra = F.floor(total / n), total % n
    big_rows = extra * (small + 1)
    tile = F.when(number <= big_rows, F.floor((number - 1) / (small + 1)) + 1).otherwise(
        extra + F.floor((number - big_rows - 1) / F.greatest(small, F.lit(1))) + 1
    )
    return tile.cast("long")
