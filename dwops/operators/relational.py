"""Filters, joins, aggregates, set operations and paging."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from dwops.functions.values import amount_avg, amount_total, exact_avg, exact_sum, month_of, months_apart, pct, total
from dwops.plans.keyed import join_on_same, with_group_values
from dwops.plans.ordered import scan_groups, sort_columns
from dwops.session import stored

# --- filters and projections -----------------------------------------------

def regex_filter(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Case-insensitive regex match."""
    return df.where(F.col(column).rlike(f"(?i){pattern}"))


def active_rows(df: DataFrame, deleted_at: str = "deleted_at") -> DataFrame:
    return df.where(F.col(deleted_at).isNull())


def drop_pii(df: DataFrame, pii: list[str], select: list[str] | None = None) -> DataFrame:
    """Rows without personal columns; asking for one by name is an error."""
    asked = sorted(set(select or []) & set(pii))
    if asked:
        raise ValueError(f"personal columns may only be aggregated: {asked}")
    return df.select(*select) if select else df.drop(*pii)


def pii_aggregate(df: DataFrame, keys: list[str], pii: list[str]) -> DataFrame:
    """Counts and distinct counts of personal columns per group."""
    aggs = [F.count(F.lit(1)).alias("num_rows")]
    for c in pii:
        aggs += [F.count(c).alias(f"{c}_count"), F.count_distinct(c).alias(f"{c}_distinct")]
    return df.groupBy(*keys).agg(*aggs)


def distinct_values(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct()


def in_list(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(values))


# --- joins -----------------------------------------------------------------

def left_default(a: DataFrame, b: DataFrame, on: list[str], defaults: dict) -> DataFrame:
    """Left join; the named columns of missing matches get a default."""
    joined = a.join(b, on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def star_join(fact: DataFrame, dims: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Fact joined to each dimension in turn; Spark broadcasts those under its size threshold."""
    for dim, condition in dims:
        fact = fact.join(dim, condition)
    return fact


def period_over_period(df: DataFrame, keys: list[str], period: str, value: str) -> DataFrame:
    """Growth of each monthly row against the month before it, NULL percentage when there is none.

    ``df`` holds one row per (keys, month). Looking back one row and checking that it is
    the month before gives the self join on ``month = previous month + 1`` without a
    second computation of the aggregate; a group has one row per month.
    """
    w = Window.partitionBy(*keys).orderBy(period)
    adjacent = F.lag(period).over(w) == F.add_months(period, -1)
    previous = F.when(adjacent, F.lag(value).over(w))
    growth = F.col(value) - F.coalesce(previous, F.lit(0))
    return (
        df.withColumn("_prev", previous)
        .withColumn("growth", growth.cast("double"))
        .withColumn("growth_pct", pct(growth, F.col("_prev")))
        .drop("_prev")
    )


def year_over_year(df: DataFrame, keys: list[str], year: Column, units: Column, digits: int, current: int) -> DataFrame:
    """Totals of a year and of the year before per key, for keys with rows in that year.

    ``units`` are whole units of 10^-digits.

    Both totals come from one grouping instead of two joined ones.
    """
    of = lambda y: total(F.when(year == y, units), digits)
    sums = df.groupBy(*keys).agg(
        F.count_if(year == current).alias("_n"), of(current).alias("_cy"), of(current - 1).alias("_py")
    ).where("_n > 0")
    return sums.select(
        *keys, F.col("_cy").cast("double").alias("cy_amount"), F.col("_py").cast("double").alias("py_amount"),
        pct((F.col("_cy") - F.col("_py")).cast("double"), "_py").alias("yoy_growth_pct"),
    )


def exists_in(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_semi")


def not_exists_in(df: DataFrame, other: DataFrame, on) -> DataFrame:
    return df.join(other, on, "left_anti")


def anti_left_null(a: DataFrame, b: DataFrame, on: list[str], probe: str) -> DataFrame:
    """Anti join spelled as left join plus IS NULL on a never-NULL column of the right side."""
    return a.join(b, on, "left").where(F.col(probe).isNull()).select(*a.columns)


def not_in(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    """``column NOT IN (other)`` with SQL's NULL rules.

    Any NULL on the right gives no rows; an empty right side gives all rows; otherwise
    a NULL on the left is dropped. Written as an anti join behind two one-row checks,
    because Spark's own null-aware anti join must broadcast the right side.
    """
    values = other.select(F.col(other_column).alias("_v"))
    facts = values.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("_v").isNull()).alias("nulls")
    )
    kept = df.join(values.where(F.col("_v").isNotNull()).distinct(), F.col(column) == F.col("_v"), "left_anti")
    rule = (facts.select("n").scalar() == 0) | (
        (facts.select("nulls").scalar() == 0) & F.col(column).isNotNull()
    )
    return kept.where(rule)


def null_safe_join(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join where NULL matches NULL."""
    return join_on_same(a, b, keys, how)


def lookup_agg(df: DataFrame, other: DataFrame, on: list[str], aggs: list[Column], zeros: list[str] = ()) -> DataFrame:
    """Several per-row scalar lookups as one grouped join; counts in ``zeros`` default to 0."""
    joined = df.join(other.groupBy(*on).agg(*aggs), on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zeros})


def above_group_avg(df: DataFrame, keys: list[str], value: str, digits: int = 2) -> DataFrame:
    """Rows whose value exceeds their group's mean (which is exact for ``digits`` decimals)."""
    means = with_group_values(df, keys, {"group_avg": exact_avg(value, digits)})
    return means.where(F.col(value) > F.col("group_avg"))


def prefiltered_join(a, condition_a: Column, b, condition_b: Column, on) -> DataFrame:
    return a.where(condition_a).join(b.where(condition_b), on)


# Rows and bytes above which a requested broadcast falls back to a merge join.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 256 << 20


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: texts by their length, nested values by their JSON, all else 8."""
    def size(field: T.StructField) -> Column:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(field.name), F.lit(0))
        if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.length(F.to_json(F.struct(field.name))), F.lit(0))
        return F.lit(8)

    return reduce(lambda a, b: a + b, [size(f).cast("long") for f in df.schema])


def hinted_join(a: DataFrame, b: DataFrame, on, strategy: str, how: str = "inner") -> DataFrame:
    """Join with a chosen strategy: ``merge``, ``shuffle_hash`` or ``broadcast``.

    A broadcast is honoured only after measuring that the right side is small, in rows and in bytes.
    """
    if strategy not in ("merge", "shuffle_hash", "broadcast"):
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "broadcast":
        rows, size = b.select(row_bytes(b).alias("_b")).limit(BROADCAST_ROWS + 1).agg(F.count(F.lit(1)), F.sum("_b")).first()
        if rows > BROADCAST_ROWS or (size or 0) > BROADCAST_BYTES:
            strategy = "merge"
    return a.join(b.hint(strategy), on, how)


def describe_ids(df: DataFrame, lookups: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Attach a label to each id column: (id column, dimension, its key, its label)."""
    for id_column, dim, key, label in lookups:
        names = dim.select(F.col(key).alias(f"_{key}"), F.col(label))
        df = df.join(names, F.col(id_column) == F.col(f"_{key}"), "left").drop(f"_{key}")
    return df


# --- aggregates ------------------------------------------------------------

def agg(df: DataFrame, keys: list, aggs: list[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs)


def agg_having(df: DataFrame, keys: list, aggs: list[Column], condition: Column) -> DataFrame:
    return agg(df, keys, aggs).where(condition)


def pivot_case(df: DataFrame, keys: list[str], column: str, values: dict, amount: Column) -> DataFrame:
    """One summed column per value; a group without the value gets 0."""
    zero = F.lit(0).cast("decimal(18,2)")
    sums = [F.sum(F.when(F.col(column) == v, amount).otherwise(zero)).cast("double").alias(n) for n, v in values.items()]
    return df.groupBy(*keys).agg(*sums)


def pivot(df: DataFrame, keys: list[str], column: str, values: dict, amount: Column) -> DataFrame:
    """One summed column per value; a group without the value gets NULL."""
    wide = df.groupBy(*keys).pivot(column, list(values.values())).agg(amount)
    return wide.withColumnsRenamed({str(v): n for n, v in values.items()})


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Columns to rows, keeping positive values."""
    return df.unpivot(ids, columns, name, value).where(F.col(value) > 0)


# The longest string that is built for one group.
STRING_BYTES = 64 << 20


def string_agg(df: DataFrame, keys: list[str], column: str, sep: str = ", ", most: int = STRING_BYTES) -> DataFrame:
    """Distinct values of a group joined in order; a group whose string would take over ``most`` bytes is an error, as in LISTAGG.

    Duplicates go before the strings are built, so a frequent value travels once, and lengths
    are added up before any value is gathered.
    """
    values = stored(df.select(*keys, column).distinct())
    length = F.sum(F.octet_length(F.col(column).cast("string")) + len(sep.encode()))
    if not values.groupBy(*keys).agg(length.alias("_b")).where(F.col("_b") > most).isEmpty():
        raise ValueError(f"a group's string takes over {most} bytes")
    return (
        values.groupBy(*keys)
        .agg(F.array_join(F.sort_array(F.collect_list(column)), sep).alias("members"))
    )


def first_members(df: DataFrame, keys: list[str], column: str, n: int = 3) -> DataFrame:
    """Groups with more than one row: their size and first ``n`` members.

    Members are cut to ``n`` per group; the first one then reads the next ones in the order they
    are in, and groups of one row go before anything is joined.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    first = top_per_key(df.select(*keys, column), keys, [column], max(n, 2))
    w = Window.partitionBy(*keys).orderBy(*sort_columns([column]))
    after = [F.col(column).alias("idx1"), *[F.lead(column, i).over(w).alias(f"idx{i + 1}") for i in range(1, n)]]
    # Places are counted again beside LEAD, so that both see equal values in one order.
    members = first.select(*keys, F.row_number().over(w).alias("_place"), F.lead("_rn").over(w).alias("_second"), *after).where("_place = 1 and _second is not null")
    return join_on_same(sizes, members.drop("_place", "_second"), keys, "inner")


def top_per_key(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` rows per key with their number ``_rn``.

    Filtering right on the row number lets Spark keep ``n`` rows per key and task before
    the shuffle, so a dominant key never travels whole.
    """
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)


def cumulative_of_agg(df: DataFrame, reset: str, period: str, value: str, name: str) -> DataFrame:
    """Running total of a per-period sum within each ``reset`` value (a year holds few periods)."""
    w = Window.partitionBy(reset).orderBy(period)
    return df.withColumn(name, F.sum(value).over(w).cast("double"))


def ratio_to_total(df: DataFrame, value: str, name: str, digits: int = 2) -> DataFrame:
    """Share of the grand total; the total enters as a scalar, not through a join."""
    total = df.agg(F.sum(value).cast("double")).scalar()
    return df.withColumn(name, F.round(F.col(value).cast("double") / total * 100, digits))


def daily_summary(df: DataFrame, ts: str, value: str, entity: str, digits: int | None = None) -> DataFrame:
    """Rows, total, mean and distinct entities per day; totals as in ``amount_total``."""
    return df.groupBy(F.col(ts).cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("order_count"),
        amount_total(value, digits).cast("double").alias("revenue"),
        amount_avg(value, digits).alias("avg_order_value"),
        F.count_distinct(entity).alias("unique_customers"),
    )


def lifetime_value(entities: DataFrame, facts: DataFrame, on: list[str], value: str, digits: int | None = None) -> DataFrame:
    """Order count and total value per entity, 0 for entities without facts; totals as in ``amount_total``."""
    totals = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("order_count"), amount_total(value, digits).cast("double").alias("lifetime_value"))
    return left_default(entities, totals, on, {"order_count": 0, "lifetime_value": 0.0})


def slowest_groups(df: DataFrame, keys: list[str], value: str, n: int = 20, digits: int = 6) -> DataFrame:
    """The ``n`` groups with the highest mean, over values taken to ``digits`` decimals."""
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        exact_sum(value, digits).alias("total_time"),
        exact_avg(value, digits).alias("mean_time"),
        F.max(value).alias("max_time"),
    )
    return stats.orderBy(F.desc("mean_time"), *keys).limit(n)


def cohort_retention(df: DataFrame, entity: str, ts: str) -> DataFrame:
    """Active entities per (first month, activity month) and their share of the cohort.

    Rows are distinct per entity and month, so counting them counts entities, and both
    windows run over at most one row per month.
    """
    active = df.select(entity, month_of(ts).alias("activity_month")).distinct()
    cohorts = active.withColumn("cohort_month", F.min("activity_month").over(Window.partitionBy(entity)))
    counts = cohorts.groupBy("cohort_month", "activity_month").agg(F.count(F.lit(1)).alias("active_users"))
    founders = F.when(F.col("activity_month") == F.col("cohort_month"), F.col("active_users"))
    return (
        counts.withColumn("cohort_size", F.max(founders).over(Window.partitionBy("cohort_month")))
        .withColumn("months_since_signup", months_apart("cohort_month", "activity_month"))
        .withColumn("retention_pct", pct("active_users", "cohort_size"))
    )


def percentiles(df: DataFrame, keys: list[str], value: str, continuous: dict[str, float], discrete: dict[str, float]) -> DataFrame:
    """Exact continuous and discrete percentiles per group.

    Equal values are counted first; running counts then tell which values stand at the
    wanted positions. Nothing but those values is gathered per group, whatever its size.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_ties"))
    placed = scan_groups(counts, keys, [value], sums={"_upto": F.col("_ties")}, derived=True)
    placed = join_on_same(placed, counts.groupBy(*keys).agg(F.sum("_ties").alias("_total")), keys, "left")

    def at(position: Column) -> Column:
        # Value holding the 0-based position.
        hit = (F.col("_upto") > position) & (F.col("_upto") - F.col("_ties") <= position)
        return F.max(F.when(hit, F.col(value)))

    aggs = []
    for name, p in continuous.items():
        place = (F.col("_total") - 1) * F.lit(float(p))
        aggs += [at(F.floor(place)).alias(f"_lo_{name}"), at(F.ceil(place)).alias(f"_hi_{name}"),
                 F.max(place - F.floor(place)).alias(f"_part_{name}")]
    for name, p in discrete.items():
        aggs.append(at(F.greatest(F.ceil(F.col("_total") * F.lit(Decimal(str(p)))) - 1, F.lit(0))).alias(name))
    out = placed.groupBy(*keys).agg(*aggs)
    lo = lambda n: F.col(f"_lo_{n}")
    return out.select(
        *keys,
        *[(lo(n) + (F.col(f"_hi_{n}") - lo(n)) * F.col(f"_part_{n}")).alias(n) for n in continuous],
        *discrete,
    )


def global_stats(df: DataFrame, aggs: dict[str, Column]) -> DataFrame:
    """Table-wide aggregates in one pass."""
    return df.agg(*[c.alias(n) for n, c in aggs.items()])


def top_n_groups(df: DataFrame, keys: list[str], value: Column, n: int) -> DataFrame:
    """Groups by descending exact total, with their place."""
    totals = df.groupBy(*keys).agg(value.alias("total"))
    best = totals.orderBy(F.desc("total"), *keys).limit(n)
    # At most n rows are left to number.
    w = Window.partitionBy().orderBy(F.desc("total"), *keys)
    return best.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("total", F.col("total").cast("double"))


# --- set operations --------------------------------------------------------

def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def union_tagged(parts: dict[str, DataFrame], tag: str = "tag") -> DataFrame:
    """All rows of all parts, each with the name of its part."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, tagged)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


# --- top-k and paging ------------------------------------------------------

def top_k(df: DataFrame, order: list[str], k: int) -> DataFrame:
    return df.orderBy(*sort_columns(order)).limit(k)


def page(df: DataFrame, order: list[str], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*sort_columns(order)).offset(offset).limit(limit)


def page_rows(df: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last`` (1-based) with their number.

    Only the first ``last`` rows are kept by the top-k step, then numbered.
    """
    head = df.orderBy(*sort_columns(order)).limit(last)
    w = Window.partitionBy().orderBy(*sort_columns(order))
    return head.withColumn("rn", F.row_number().over(w).cast("long")).where(F.col("rn") >= first)


def page_after(df: DataFrame, key: str, last_seen, limit: int) -> DataFrame:
    """Next page behind a known key: cheap however deep the page lies."""
    return df.where(F.col(key) > F.lit(last_seen)).orderBy(key).limit(limit)
