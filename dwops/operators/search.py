"""Search over document lines, fields and cells, and term tagging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dwops.functions.values import any_of, matches
from dwops.operators.relational import top_per_key
from dwops.plans.keyed import join_on_same, spread


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, text), one row per line, numbered from 1."""
    cut = F.posexplode(F.split(F.col(text), "\n"))
    return df.select(key, cut.alias("line", "line_text")).withColumn("line", (F.col("line") + 1).cast("long"))


def _may_match(text: str, pattern: str, regex: bool) -> Column:
    """A whole-text test that never misses a matching line; skips most texts before they are cut."""
    if regex or "\n" in pattern:
        return F.lit(True)
    return matches(text, pattern, regex=False)


def search_lines(df: DataFrame, key: str, text: str, pattern: str, regex: bool = False) -> DataFrame:
    """Lines matching a case-insensitive substring or regex."""
    cut = lines_of(df.where(_may_match(text, pattern, regex)), key, text)
    return cut.where(matches("line_text", pattern, regex))


def search_objects(df: DataFrame, key: str, text: str, a: str | None, b: str | None, regex: bool = False,
                   limit: int | None = None, keep_lines: int | None = None) -> DataFrame:
    """Documents with a line for each given term (not necessarily the same one).

    Lines matching either count. All documents come with all their line numbers, unless
    ``limit`` asks for the first documents by key, ``keep_lines`` for the first lines only.
    """
    terms = [t for t in (a, b) if t]
    if not terms:
        raise ValueError("give at least one term")
    whole = reduce(lambda x, y: x & y, [_may_match(text, t, regex) for t in terms])
    flags = {f"_m{i}": matches("line_text", t, regex) for i, t in enumerate(terms)}
    hits = lines_of(df.where(whole), key, text).withColumns(flags).where(any_of([F.col(f) for f in flags]))
    # A document's own line numbers, so the array is shorter than its text.
    lines = F.sort_array(F.collect_list("line"))
    listed = F.slice(lines, 1, keep_lines) if keep_lines else lines
    found = hits.groupBy(key).agg(
        F.count(F.lit(1)).alias("match_count"), F.array_join(listed, ",").alias("matching_lines"), *[F.max(f).alias(f) for f in flags]
    )
    kept = found.where(reduce(lambda x, y: x & y, [F.col(f) for f in flags])).select(key, "match_count", "matching_lines")
    return kept.orderBy(key).limit(limit) if limit else kept


def search_sources(source: DataFrame, keys: list[str], line: str, text: str, a: str | None, b: str | None, regex: bool = False,
                   within: dict[str, list] | None = None, limit: int | None = None, keep_lines: int | None = 100) -> DataFrame:
    """Objects of a source table (one row a line) with a line for each given term: keys, match_count, matching_lines.

    ``keys`` name an object (owner, name and type, say), ``within`` holds allowed values of some
    of them. Lines matching either term count; their first ``keep_lines`` numbers are listed.
    Rows of NULL keys form objects like others. Matching lines are few, so they are what is grouped.
    """
    terms = [t for t in (a, b) if t]
    if not terms:
        raise ValueError("give at least one term")
    chosen = source
    for name, allowed in (within or {}).items():
        chosen = chosen.where(F.col(name).isin(list(allowed)))
    flags = {f"_m{i}": matches(text, t, regex) for i, t in enumerate(terms)}
    hits = chosen.select(*keys, line, *[c.alias(n) for n, c in flags.items()]).where(any_of([F.col(f) for f in flags]))
    counted = hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("match_count"), *[F.max(f).alias(f) for f in flags])
    found = counted.where(reduce(lambda x, y: x & y, [F.col(f) for f in flags])).select(*keys, "match_count")
    if limit:
        found = found.orderBy(*keys).limit(limit)
    # Only the lines to be listed are gathered.
    first = top_per_key(join_on_same(hits.select(*keys, line), found.select(*keys), keys, "left_semi"), keys, [line], keep_lines) if keep_lines else hits
    listed = first.groupBy(*keys).agg(F.sort_array(F.collect_list(line)).alias("matching_lines"))
    return join_on_same(found, listed, keys, "left")


def source_of(source: DataFrame, objects: DataFrame, keys: list[str], line: str, text: str, limit_lines: int = 0) -> DataFrame:
    """The lines (right-trimmed) of the found objects with their match counts; 0 = all lines of each."""
    kept = source.where(F.col(line) <= limit_lines) if limit_lines > 0 else source
    found = objects.select(*keys, "match_count", "matching_lines")
    met = join_on_same(kept.select(*keys, line, F.rtrim(text).alias(text)), found, keys, "inner")
    return met.select(*keys, "match_count", "matching_lines", line, text)


def fetch_objects(df: DataFrame, key: str, text: str, names: list | DataFrame, owner: str | None = None,
                  owners: list | None = None, limit_lines: int = 0) -> DataFrame:
    """Lines of the documents of the given names, optionally of given owners; 0 = all lines.

    ``names`` is a list, or a table whose first column holds the names.
    """
    if isinstance(names, DataFrame):
        wanted = names.select(F.col(names.columns[0]).alias("_name"))
        chosen = df.join(wanted, F.col(key) == F.col("_name"), "left_semi")
    else:
        chosen = df.where(F.col(key).isin(names))
    if owner and owners:
        chosen = chosen.where(F.col(owner).isin(owners))
    cut = lines_of(chosen, key, text)
    return cut.where(F.col("line") <= limit_lines) if limit_lines > 0 else cut


def search_fields(df: DataFrame, columns: list[str], pattern: str, regex: bool = True) -> DataFrame:
    """Rows where any of the columns matches, with the names of those that do."""
    hit = F.filter(
        F.array(*[F.when(matches(c, pattern, regex), F.lit(c)) for c in columns]), lambda x: x.isNotNull()
    )
    return df.withColumn("matched_fields", F.array_join(hit, ",")).where(F.col("matched_fields") != "")


def search_cells(df: DataFrame, table: str, key: str, pattern: str, regex: bool = True) -> DataFrame:
    """Cells matching a pattern: where they are, and the row as ``name=value | name=value``."""
    text = {c: F.col(c).cast("string") for c in df.columns}
    filled = [F.when(F.length(text[c]) > 0, F.concat(F.lit(f"{c}="), text[c])) for c in df.columns]
    context = F.concat_ws(" | ", *filled)
    cells = F.array(*[F.struct(F.lit(c).alias("field"), text[c].alias("cell")) for c in df.columns])
    rows = df.where(any_of([matches(text[c], pattern, regex) for c in df.columns]))
    out = rows.select(F.lit(table).alias("table_name"), text[key].alias("row_key"), context.alias("context"), F.inline(cells))
    return out.where(matches("cell", pattern, regex))


def search_headers(df: DataFrame, table: str, pattern: str, regex: bool = True) -> DataFrame:
    """Column names that match: table_name, field, position (from 0), context. Works on the schema alone."""
    names = df.sparkSession.createDataFrame([(table, c, i) for i, c in enumerate(df.columns)], "table_name string, field string, position int")
    context = F.concat(F.lit("Header ["), F.col("position").cast("string"), F.lit("]: "), F.col("field"))
    return names.withColumn("context", context).where(matches("field", pattern, regex))


def search_table(df: DataFrame, table: str, key: str, pattern: str, regex: bool = True) -> DataFrame:
    """Header and cell hits of a table together: table_name, matched_field (header or cell), row_key, field, cell, context."""
    headers = search_headers(df, table, pattern, regex).select(
        "table_name", F.lit("header").alias("matched_field"), F.lit(None).cast("string").alias("row_key"), "field", F.col("field").alias("cell"), "context")
    cells = search_cells(df, table, key, pattern, regex).select("table_name", F.lit("cell").alias("matched_field"), "row_key", "field", "cell", "context")
    return headers.unionByName(cells)


# Length of the term start that is looked up in the texts.
GRAM = 3
# Number of terms up to which every text is simply tested for each of them.
FEW_TERMS = 1_000


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of a fixed length, taken at every position."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1))


def tag_terms(docs: DataFrame, key: str, text: str, terms: DataFrame, term: str, few: int = FEW_TERMS) -> DataFrame:
    """Which terms occur, case-insensitively, in which texts.

    A short glossary (counted first) travels to the texts as one array value, so the
    texts are read once and never shuffled. For a long one the texts meet the terms
    through an equality join: a term can only occur where its first three characters do,
    and the substring test then decides. There equal rows are counted first and given
    back at the end, so the result is the same, also for repeated and NULL keys.
    """
    low = spread(docs.select(key, text)).select(key, F.lower(F.col(text)).alias("_text")).where(F.length("_text") > 0)
    words = terms.where(F.length(term) > 0).withColumn("_term", F.lower(F.col(term)))
    columns = [F.col(c) for c in terms.columns]
    if words.limit(few + 1).count() <= few:
        glossary = words.agg(F.collect_list(F.struct("_term", F.struct(*columns).alias("_entry")))).scalar()
        found = F.filter("_glossary", lambda w: F.contains(F.col("_text"), w["_term"]))
        return low.withColumn("_glossary", glossary).select(key, F.explode(F.transform(found, lambda w: w["_entry"])).alias("_entry")).select(key, "_entry.*")
    words = words.withColumn("_size", F.least(F.length("_term"), F.lit(GRAM))).withColumn("_gram", F.substring("_term", 1, GRAM))
    sizes = sorted(r["_size"] for r in words.select("_size").distinct().collect())
    low = low.withColumn("_hash", F.md5("_text")).groupBy(key, "_hash").agg(
        F.first("_text").alias("_text"), F.count(F.lit(1)).cast("int").alias("_copies"))
    parts = [low.select(key, "_hash", F.lit(n).alias("_size"), F.explode(_grams(F.col("_text"), n)).alias("_gram")) for n in sizes]
    starts = reduce(DataFrame.unionByName, parts)
    pairs = starts.join(words, ["_size", "_gram"]).select(key, "_hash", *columns, "_term")
    found = join_on_same(pairs, low, [key, "_hash"], "inner").where(F.contains("_text", "_term"))
    return found.select(key, *columns, F.explode(F.array_repeat(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")


def union_canonical(parts: dict[str, DataFrame], aliases: dict[str, str], tag: str = "origin") -> DataFrame:
    """Tables whose columns are spelled differently, under common names.

    Headers are trimmed and lower-cased before the lookup; of several columns with the
    same common name the first one counts; columns without a common name are left out.
    """
    lookup = {k.strip().lower(): v for k, v in aliases.items()}
    renamed = []
    for name, df in parts.items():
        picked: dict[str, str] = {}
        for c in df.columns:
            common = lookup.get(c.strip().lower())
            if common and common not in picked:
                picked[common] = c
        renamed.append(df.select(*[F.col(f"`{c}`").alias(n) for n, c in picked.items()]).withColumn(tag, F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)
