"""Finding how tables join: proposals from names, measured on the data."""

from __future__ import annotations

from itertools import combinations, product
import re

from pyspark.sql import DataFrame, functions as F, types as T

from dwops.plans.keyed import in_parts
from dwops.session import stored

# Column endings that mark a key.
KEY_ENDINGS = ("_ID", "_KEY", "_CODE")
REFERENCE_ENDINGS = ("_ID", "_CODE", "_KEY", "_NO", "_NUM")


def plain_name(column: str) -> str:
    """Upper-case name without a one- or two-letter table prefix."""
    return re.sub(r"^[A-Z]{1,2}_", "", column.upper())


def _by_name(columns: list[str], clean) -> dict[str, list[str]]:
    """Columns under their cleaned name, which several may share."""
    names: dict[str, list[str]] = {}
    for c in columns:
        names.setdefault(clean(c), []).append(c)
    return names


def propose_joins(columns: dict[str, list[str]], normalise: bool = True) -> list[tuple]:
    """(table1, column1, table2, column2, rule, confidence) for every table pair, from names alone.

    Works on column lists, not on data.
    """
    clean = plain_name if normalise else str.upper
    found = []
    for (t1, cols1), (t2, cols2) in combinations(columns.items(), 2):
        names1, names2 = _by_name(cols1, clean), _by_name(cols2, clean)
        for n in sorted(names1.keys() & names2.keys()):
            confidence = "HIGH" if n.endswith(KEY_ENDINGS) else "MEDIUM"
            found += [(t1, c1, t2, c2, "COMMON_COLUMN", confidence) for c1, c2 in product(names1[n], names2[n])]
        for owner, own, other, theirs in ((t1, names1, t2, names2), (t2, names2, t1, names1)):
            for n in sorted(theirs):
                ending = next((e for e in REFERENCE_ENDINGS if n.endswith(e)), None)
                if ending is None or not n.startswith(owner.upper()) or n in own or ending[1:] not in own:
                    continue
                for key, reference in product(own[ending[1:]], theirs[n]):
                    pair = (owner, key, other, reference)
                    ordered = pair if owner == t1 else pair[2:] + pair[:2]
                    found.append((*ordered, "NAMING_CONVENTION", "MEDIUM"))
    return found


def naming_hints(columns: dict[str, list[str]]) -> list[tuple]:
    """References that a column's name suggests: (table, column, referenced table, its column, NAMING_CONVENTION, MEDIUM).

    A column that ends like a key refers to every other table whose name holds what comes before
    the ending: to its column named by the ending alone, by its own name and the ending, or like
    the column itself, the first of these that it has. Works on names, not on data.
    """
    upper = {t: {c.upper(): c for c in cols} for t, cols in columns.items()}
    found = []
    for table, names in upper.items():
        for name, column in names.items():
            ending = next((e for e in REFERENCE_ENDINGS if name.endswith(e)), None)
            prefix = name.removesuffix(ending or "")
            if not ending or not prefix or prefix == table.upper():
                continue
            for other, theirs in upper.items():
                if other == table or prefix not in other.upper():
                    continue
                target = next((k for k in (ending[1:], f"{other.upper()}{ending}", name) if k in theirs), None)
                if target:
                    found.append((table, column, other, theirs[target], "NAMING_CONVENTION", "MEDIUM"))
    return found


def contained_columns(tables: dict[str, DataFrame]) -> DataFrame:
    """All pairs of columns, whatever their names, where every value of the one occurs in the other.

    A theta sketch per column keeps its values with the smallest hashes. Where the sketches say
    that a value of A is not in B, the pair is dropped; a sketch never says so of a pair that holds, so
    none is lost. The rest, usually few of the many pairs, is measured on the data. Columns
    without values are in nothing. Returns table1, column1 (contained) and table2, column2 (containing),
    their distinct values, row counts and whether the containing column is unique.
    """
    spark = next(iter(tables.values())).sparkSession
    wanted = {(t, c) for t, df in tables.items() for c in df.columns}
    # One row a column of the schema.
    sketches = stored(column_values(tables, wanted).groupBy("tbl", "col").agg(F.theta_sketch_agg("value").alias("sketch")))
    places = spark.createDataFrame([(*a, *b) for a in sorted(wanted) for b in sorted(wanted) if a != b], "table1 string, column1 string, table2 string, column2 string")
    side = lambda n: sketches.withColumnsRenamed({"tbl": f"table{n}", "col": f"column{n}", "sketch": f"sketch{n}"})
    pairs = places.join(side(1), ["table1", "column1"]).join(side(2), ["table2", "column2"])
    open_pairs = pairs.where(F.theta_sketch_estimate(F.theta_difference("sketch1", "sketch2")) == 0).select("table1", "column1", "table2", "column2").collect()
    if not open_pairs:
        return measure_pairs(tables, [(*sorted(wanted)[0], *sorted(wanted)[0], "VALUES", "HIGH")]).where(F.lit(False)).select(*CONTAINED)
    measured = measure_pairs(tables, [(*r, "VALUES", "HIGH") for r in open_pairs])
    return measured.where("matched_rows1 = rows1 and rows1 > 0").select(*CONTAINED)


CONTAINED = ["table1", "column1", "table2", "column2", "distinct1", "distinct2", "rows1", "rows2", "unique2"]


# Values up to this length are compared as they are, longer ones by their hash.
PLAIN_LENGTH = 32
# Types whose text is never longer than that.
FIXED_WIDTH = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def column_values(tables: dict[str, DataFrame], wanted: set[tuple[str, str]]) -> DataFrame:
    """(tbl, col, value, cnt) of the wanted columns.

    Long texts are shuffled as a marked MD5, which is longer than any plain value. Fixed-width
    values become text behind the exchange that bounds the cells of a task.
    """
    parts = []
    for name, df in tables.items():
        columns = sorted(c for t, c in wanted if t == name)
        if columns:
            text = {c: F.col(c).cast("string") for c in columns}
            short = {c: F.when(F.length(v) <= PLAIN_LENGTH, v).otherwise(F.concat(F.lit("md5:"), F.md5(v))) for c, v in text.items()}
            rows = in_parts(df.select(*[F.col(c) if isinstance(df.schema[c].dataType, FIXED_WIDTH) else short[c].alias(c) for c in columns]), len(columns))
            cells = [F.struct(F.lit(name).alias("tbl"), F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in columns]
            parts.append(rows.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull()))
    all_cells = parts[0]
    for p in parts[1:]:
        all_cells = all_cells.unionByName(p)
    return all_cells.groupBy("tbl", "col", "value").agg(F.count(F.lit(1)).alias("cnt"))


def measure_pairs(tables: dict[str, DataFrame], proposals: list[tuple]) -> DataFrame:
    """Value inclusion for each proposed pair, in one job for all pairs.

    Columns are reduced to distinct values with counts and stored. What a pair says of one
    side alone is counted once a column. What it says of both comes from a join of the values with
    themselves: a value is shuffled once per column holding it and side, however many pairs
    the column takes part in, and only what two columns share is counted by pair.
    """
    spark = next(iter(tables.values())).sparkSession
    wanted = sorted({(t, c) for p in proposals for t, c in ((p[0], p[1]), (p[2], p[3]))})
    place = {c: i for i, c in enumerate(wanted)}
    # Column names only: these lists grow with the schema, not with the data.
    names = spark.createDataFrame([(i, *c) for c, i in place.items()], "id int, tbl string, col string")
    pairs = spark.createDataFrame(
        [(i, place[p[0], p[1]], place[p[2], p[3]], *p) for i, p in enumerate(proposals)],
        "pair int, id1 int, id2 int, table1 string, column1 string, table2 string, column2 string, rule string, confidence string",
    )
    held = stored(column_values(tables, set(wanted)).join(F.broadcast(names), ["tbl", "col"]).select("id", "value", "cnt"))
    columns = held.groupBy("id").agg(F.count(F.lit(1)).alias("distinct"), F.sum("cnt").alias("rows"), (F.max("cnt") == 1).alias("unique"))
    side = lambda n: held.select(F.col("id").alias(f"id{n}"), "value", F.col("cnt").alias(f"n{n}")).where(F.col(f"id{n}").isin(sorted({place[p[2 * n - 2], p[2 * n - 1]] for p in proposals})))
    shared = side(1).join(side(2), "value").join(F.broadcast(pairs.select("pair", "id1", "id2")), ["id1", "id2"])
    common = shared.groupBy("pair").agg(F.count(F.lit(1)).alias("common_values"), F.sum("n1").alias("matched_rows1"), F.sum("n2").alias("matched_rows2"))
    # From here on a row a pair.
    of = lambda n: columns.withColumnsRenamed({c: f"{c}{n}" for c in columns.columns})
    measured = pairs.join(of(1), "id1", "left").join(of(2), "id2", "left").join(common, "pair", "left").where("distinct1 is not null or distinct2 is not null")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return measured.select(
        "table1", "column1", "table2", "column2", "rule", "confidence", zero("distinct1"), zero("distinct2"), zero("common_values"),
        zero("rows1"), zero("rows2"), zero("matched_rows1"), zero("matched_rows2"),
        *[F.coalesce(f"unique{n}", F.lit(False)).alias(f"unique{n}") for n in (1, 2)],
    )


def inclusion_deps(tables: dict[str, DataFrame], proposals: list[tuple]) -> DataFrame:
    """Share of rows and of distinct values of column 1 found in column 2, and the cardinality."""
    m = measure_pairs(tables, proposals)
    many = lambda unique: F.when(F.col(unique), "1").otherwise("N")
    crossed = ~F.col("unique1") & ~F.col("unique2")
    return m.withColumns({
        "row_inclusion": F.col("matched_rows1") / F.nullif("rows1", F.lit(0)),
        "value_inclusion": F.col("common_values") / F.nullif("distinct1", F.lit(0)),
        "cardinality": F.when(crossed, "N:M").otherwise(F.concat(many("unique1"), F.lit(":"), many("unique2"))),
    })


def inclusion(child: DataFrame, child_column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Inclusion of one column in another."""
    return inclusion_deps({"child": child, "parent": parent},
                          [("child", child_column, "parent", parent_column, "GIVEN", "HIGH")])


def discover_joins(tables: dict[str, DataFrame], normalise: bool = True) -> DataFrame:
    """Every proposed join over the tables, measured.

    ``direction`` is seen from table 1: OUTGOING when its rows refer to a unique column
    of table 2, INCOMING the other way round, BOTH for 1:1, NONE without common values.
    """
    proposals = propose_joins({n: df.columns for n, df in tables.items()}, normalise)
    m = measure_pairs(tables, proposals)
    direction = (
        F.when(F.col("common_values") == 0, "NONE").when(F.col("unique1") & F.col("unique2"), "BOTH")
        .when(F.col("unique2"), "OUTGOING").when(F.col("unique1"), "INCOMING").otherwise("NONE")
    )
    share = lambda n: F.col(f"matched_rows{n}") / F.nullif(f"rows{n}", F.lit(0))
    return m.withColumns({"direction": direction, "match1": share(1), "match2": share(2)}).select(
        "table1", "column1", "table2", "column2", "rule", "confidence", "direction", "common_values", "match1", "match2"
    )
