"""Data quality: profiles, constraints, dependencies, result checks and PII scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from dwops.functions.values import pct
from dwops.operators.relational import top_per_key
from dwops.plans.keyed import in_parts, spread
from dwops.session import stored, stored_counted

# Types whose lowest and highest values say nothing.
NO_MIN_MAX = (T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, cnt) for all columns in one pass; NULLs included, values as text."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent non-NULL values per column; equal counts in value order."""
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    return top_per_key(counts, ["column"], ["-cnt", "value"], k).withColumn("rank", F.col("_rn").cast("long")).drop("_rn")


def profile(df: DataFrame, columns: list[str] | None = None, skip_min_max: list[str] = (), k: int = 5) -> DataFrame:
    """Per column: rows, distinct values, NULLs and their share, lowest, highest, top values.

    Two passes whatever the number of columns: one aggregate row, and one grouping by
    (column, value) that yields both the distinct counts and the top values.
    """
    columns = columns or df.columns
    types = {c: df.schema[c].dataType for c in columns}
    bounds = [c for c in columns if c not in skip_min_max and not isinstance(types[c], NO_MIN_MAX)]
    one = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.min(c).cast("string").alias(f"_min_{c}") for c in bounds],
        *[F.max(c).cast("string").alias(f"_max_{c}") for c in bounds],
    )
    nothing = F.lit(None).cast("string")
    per_column = one.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.lit(types[c].simpleString()).alias("data_type"), F.col("_rows").alias("total_rows"),
            (F.col(f"_min_{c}") if c in bounds else nothing).alias("min"),
            (F.col(f"_max_{c}") if c in bounds else nothing).alias("max"),
        ) for c in columns
    ])))
    # Both uses read the counts, so Spark shuffles them once.
    counts = value_counts(df, columns).where(F.col("value").isNotNull())
    filled = counts.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"), F.sum("cnt").alias("_filled"))
    best = top_per_key(counts, ["column"], ["-cnt", "value"], k).groupBy("column").agg(
        F.sort_array(F.collect_list(F.struct("_rn", "value", "cnt"))).alias("_t")
    )
    tops = best.select("column", F.array_join(F.transform("_t", lambda t: F.concat(t["value"], F.lit(":"), t["cnt"])), "|").alias("top_values"))
    return (
        per_column.join(filled, "column", "left").join(tops, "column", "left")
        .withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
        .withColumn("null_count", F.col("total_rows") - F.coalesce("_filled", F.lit(0)))
        .withColumn("null_pct", F.coalesce(pct("null_count", "total_rows"), F.lit(0.0)))
        .drop("_filled")
    )


# --- constraints -----------------------------------------------------------

def check_unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that occur more than once; keys with a NULL are exempt, as in UNIQUE."""
    return df.dropna(subset=columns).groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def check_unique_where(df: DataFrame, columns: list[str], condition: Column) -> DataFrame:
    return check_unique(df.where(condition), columns)


def check_fk(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-NULL key is missing from the parent."""
    known = parent.select(F.col(key).alias("_key"))
    return child.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_key"), "left_anti")


def delete_impact(parent: DataFrame, name: str, steps: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """Rows a cascading delete of ``parent`` would remove, per table down the chain.

    ``steps``: (table name, child table, its foreign key, the key of the table above).
    """
    # Of each table the rows to go are found once and written with the key that the next step asks for alone.
    keys = [key for *_, key in steps] + [None]
    kept = lambda df, key: df.select(F.col(key).alias("_key") if key else F.lit(True).alias("_key"))
    doomed, n = stored_counted(kept(parent, keys[0]))
    counts = [(n, name)]
    for (table, child, fk, _), key in zip(steps, keys[1:]):
        doomed, n = stored_counted(kept(child.join(doomed, F.col(fk) == F.col("_key"), "left_semi"), key))
        counts.append((n, table))
    return parent.sparkSession.createDataFrame(counts, "rows_deleted long, table_name string")


def _rows_of(one: DataFrame, structs: list[Column]) -> DataFrame:
    return one.select(F.inline(F.array(*structs)))


def check_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_n_{c}") for c in columns])
    return _rows_of(one, [
        F.struct(F.lit(c).alias("column"), (F.col("_rows") - F.col(f"_n_{c}")).alias("null_rows")) for c in columns
    ])


def apply_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    return df.fillna(defaults)


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows breaking each CHECK rule; a rule that is NULL for a row passes."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(~r).alias(f"_v_{n}") for n, r in rules.items()])
    return _rows_of(one, [
        F.struct(F.lit(n).alias("rule"), F.col("_rows").alias("checked_rows"), F.col(f"_v_{n}").alias("violations"))
        for n in rules
    ])


# --- dependencies ----------------------------------------------------------

def check_fd(df: DataFrame, lhs: list[str], rhs: str) -> DataFrame:
    """Groups of ``lhs`` with more than one value of ``rhs``."""
    return df.groupBy(*lhs).agg(F.count_distinct(rhs).alias("distinct_values")).where("distinct_values > 1")


def find_fds(df: DataFrame, columns: list[str]) -> DataFrame:
    """All single-column dependencies: a determines b when the pairs are as many as the a values.

    Every column and every unordered pair is counted in one grouping; combining on the map
    side leaves only distinct values in the shuffle.
    """
    text = [F.col(c).cast("string") for c in columns]
    numbered = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    cells = [F.struct(F.lit(n).alias("n"), text[i].alias("va"), (text[j] if j > i else F.lit(None).cast("string")).alias("vb")) for n, (i, j) in enumerate(numbered)]
    counts = in_parts(df.select(*columns), len(cells)).select(F.inline(F.array(*cells))).distinct().groupBy("n").agg(F.count(F.lit(1)).alias("size"))
    # A few rows per column from here on.
    names = df.sparkSession.createDataFrame([(n, columns[i], columns[j]) for n, (i, j) in enumerate(numbered)], "n int, a string, b string")
    sizes = counts.join(F.broadcast(names), "n").select("a", "b", F.col("size").alias("n"))
    both = F.array(F.struct(F.col("a").alias("determinant"), F.col("b").alias("dependent"), F.col("n").alias("pairs")),
                   F.struct(F.col("b").alias("determinant"), F.col("a").alias("dependent"), F.col("n").alias("pairs")))
    pairs = sizes.where("a <> b").select(F.inline(both))
    singles = sizes.where("a = b").select(F.col("a").alias("determinant"), F.col("n").alias("singles"))
    return pairs.join(singles, "determinant").select(
        "determinant", "dependent", "singles", "pairs", (F.col("pairs") == F.col("singles")).alias("holds")
    )


def decompose(df: DataFrame, key: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split off the columns a key determines: (remaining table, lookup table)."""
    return df.drop(*columns), df.select(*key, *columns).distinct()


# --- result checks ---------------------------------------------------------

def all_null_columns(df: DataFrame) -> DataFrame:
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_n_{c}") for c in df.columns])
    return _rows_of(one, [
        F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"_n_{c}").alias("non_null")) for c in df.columns
    ]).where((F.col("non_null") == 0) & (F.col("rows") > 0)).drop("non_null")


def check_result(df: DataFrame, min_rows: int, max_rows: int, not_null: list[str]) -> DataFrame:
    """Row count in range and no NULLs in the named columns, as pass / fail rows."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(f"_n_{c}") for c in not_null])
    entry = lambda name, value, ok: F.struct(F.lit(name).alias("check"), value.alias("found"), ok.alias("passed"))
    entries = [entry("row_count", F.col("_rows"), F.col("_rows").between(min_rows, max_rows))]
    for c in not_null:
        nulls = F.col("_rows") - F.col(f"_n_{c}")
        entries.append(entry(f"not_null:{c}", nulls, nulls == 0))
    return _rows_of(one, entries)


def probe_stages(stages: list[tuple[str, DataFrame]], columns: list[str]) -> DataFrame:
    """Rows and non-NULL counts after each step, and which step first empties or nulls them."""
    parts = []
    for i, (name, df) in enumerate(stages, 1):
        present = [c for c in columns if c in df.columns]
        parts.append(df.agg(
            F.lit(i).cast("long").alias("step"), F.lit(name).alias("stage"), F.count(F.lit(1)).alias("rows"),
            *[(F.count(c) if c in present else F.lit(None).cast("long")).alias(f"{c}_non_null") for c in columns],
        ))
    all_stages = reduce(DataFrame.unionByName, parts)
    broken = F.col("rows") == 0
    for c in columns:
        broken = broken | F.coalesce(F.col(f"{c}_non_null") == 0, F.lit(False))
    # A row a stage, read twice below: stored, so that the stages run once.
    marked = stored(all_stages.withColumn("_broken", broken))
    first = marked.agg(F.min(F.when(F.col("_broken"), F.col("step"))).alias("s")).scalar()
    return marked.withColumn("at_fault", F.coalesce(F.col("step") == first, F.lit(False))).drop("_broken")


def verify_join(a: DataFrame, a_key: str, b: DataFrame, b_key: str, name: str) -> DataFrame:
    """How a join behaves: matched rows, match rate, orphans on both sides, fan-out.

    Both sides are counted per key first, so the join sees one row per key.
    """
    left = a.groupBy(F.col(a_key).alias("_key")).agg(F.count(F.lit(1)).alias("_a"))
    right = b.groupBy(F.col(b_key).alias("_key")).agg(F.count(F.lit(1)).alias("_b"))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return left.join(right, "_key", "full").agg(
        F.lit(name).alias("join_name"),
        total(F.when(both, F.col("_a") * F.col("_b"))).alias("joined_rows"),
        total("_a").alias("left_rows"),
        total(F.when(both, F.col("_a"))).alias("left_matched"),
        total(F.when(F.col("_b").isNull(), F.col("_a"))).alias("left_orphans"),
        total(F.when(F.col("_a").isNull(), F.col("_b"))).alias("right_orphans"),
        F.max(F.when(both, F.col("_b"))).alias("max_fan_out"),
    ).withColumn("match_pct", pct("left_matched", "left_rows")).withColumn("verified", F.col("joined_rows") > 0)


def dead_ratio(df: DataFrame, keys: list[str], deleted: Column) -> DataFrame:
    """Live and dead rows per group and the share of dead ones."""
    return df.groupBy(*keys).agg(
        F.count_if(deleted).alias("dead_rows"), F.count_if(~deleted).alias("live_rows")
    ).withColumn("dead_pct", pct("dead_rows", F.col("live_rows") + F.col("dead_rows")))


# --- PII -------------------------------------------------------------------

# Fixed patterns for values that look personal, in the syntax Java and RE2 share.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\+?[0-9]{1,3}[-. ][0-9]{3}[-. ][0-9]{3,4}",
    "id_number": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}


def pii_scan(df: DataFrame, table: str, columns: list[str], patterns: dict[str, str] = PII_PATTERNS) -> DataFrame:
    """Share of a column's values containing each pattern, all columns in one pass."""
    pairs = [(c, n, p) for c in columns for n, p in patterns.items()]
    one = spread(df.select(*columns)).agg(
        *[F.count(c).alias(f"_n_{c}") for c in columns],
        *[F.count_if(F.col(c).rlike(p)).alias(f"_h_{c}_{n}") for c, n, p in pairs],
    )
    return _rows_of(one, [
        F.struct(
            F.lit(table).alias("table_name"), F.lit(c).alias("column"), F.lit(n).alias("kind"),
            F.col(f"_n_{c}").alias("values"), F.col(f"_h_{c}_{n}").alias("hits"),
            pct(f"_h_{c}_{n}", f"_n_{c}").alias("hit_pct"),
        ) for c, n, _ in pairs
    ])
