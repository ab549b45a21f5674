"""Join discovery and text search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from dwops.operators import discovery, search
from dwops.reports.registry import Tables, report

# Every column of the star schema and of the text tables.
STAR = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "benchmark": ["item_id", "text"],
}


def _proposals_sql() -> str:
    """Column values, name rules and measures, all stated in SQL."""
    cells = " union all ".join(
        f"select '{t}' as tbl, {i} as pos, '{c}' as col, cast({c} as varchar) as value, count(*) as cnt from {t} group by 4"
        for i, (t, cols) in enumerate(STAR.items()) for c in cols)
    return f"""cells as (select *, regexp_replace(upper(col), '^[A-Z]{{1,2}}_', '') as name from ({cells})),
cols as (select distinct tbl, pos, col, name from cells),
props as (
  select a.tbl as table1, a.col as column1, b.tbl as table2, b.col as column2, 'COMMON_COLUMN' as rule,
    case when regexp_matches(a.name, '_(ID|KEY|CODE)$') then 'HIGH' else 'MEDIUM' end as confidence
  from cols a join cols b on a.name = b.name and a.pos < b.pos),
m as (select table1, column1, table2, column2, rule, confidence,
  (select count(*) from cells where tbl = table1 and col = column1) as distinct1, (select count(*) from cells where tbl = table2 and col = column2) as distinct2,
  (select count(*) from cells x join cells y on x.value = y.value where x.tbl = table1 and x.col = column1 and y.tbl = table2 and y.col = column2) as common_values,
  (select cast(sum(cnt) as bigint) from cells where tbl = table1 and col = column1) as rows1, (select cast(sum(cnt) as bigint) from cells where tbl = table2 and col = column2) as rows2,
  (select cast(coalesce(sum(x.cnt), 0) as bigint) from cells x join cells y on x.value = y.value where x.tbl = table1 and x.col = column1 and y.tbl = table2 and y.col = column2) as matched_rows1,
  (select cast(coalesce(sum(y.cnt), 0) as bigint) from cells x join cells y on x.value = y.value where x.tbl = table1 and x.col = column1 and y.tbl = table2 and y.col = column2) as matched_rows2,
  (select max(cnt) = 1 from cells where tbl = table1 and col = column1) as unique1, (select max(cnt) = 1 from cells where tbl = table2 and col = column2) as unique2 from props)"""


def _star(t: Tables) -> dict[str, DataFrame]:
    return {name: t(name, *columns) for name, columns in STAR.items()}


@report("discover_joins", f"""with {_proposals_sql()}
select table1, column1, table2, column2, rule, confidence, case when common_values = 0 then 'NONE' when unique1 and unique2 then 'BOTH' when unique2 then 'OUTGOING' when unique1 then 'INCOMING' else 'NONE' end as direction,
  common_values, matched_rows1 / nullif(rows1, 0) as match1, matched_rows2 / nullif(rows2, 0) as match2 from m""")
def discover_joins(t: Tables) -> DataFrame:
    return discovery.discover_joins(_star(t))


@report("inclusion_deps", f"""with {_proposals_sql()}
select *, matched_rows1 / nullif(rows1, 0) as row_inclusion, common_values / nullif(distinct1, 0) as value_inclusion,
  case when not unique1 and not unique2 then 'N:M' else case when unique1 then '1' else 'N' end || ':' || case when unique2 then '1' else 'N' end end as cardinality from m""")
def inclusion_deps(t: Tables) -> DataFrame:
    return discovery.inclusion_deps(_star(t), discovery.propose_joins(STAR))


def _cells(tables: dict[str, list[str]]) -> str:
    return " union all ".join(f"select '{t}' as tbl, '{c}' as col, cast({c} as varchar) as value, count(*) as cnt from {t} where {c} is not null group by 3" for t, cols in tables.items() for c in cols)


# Columns of unlike names, numbers and texts.
MIXED = {n: STAR[n] for n in ("nation", "customer", "supplier", "part", "orders", "labels")} | {"documents": ["doc_id", "lang", "source", "n_chars"]}


@report("contained_columns", f"""with cells as ({_cells(MIXED)}),
sizes as (select tbl, col, count(*) as n, cast(sum(cnt) as bigint) as num_rows, max(cnt) = 1 as is_unique from cells group by 1, 2),
common as (select a.tbl as table1, a.col as column1, b.tbl as table2, b.col as column2, count(*) as n from cells a join cells b on a.value = b.value and (a.tbl, a.col) <> (b.tbl, b.col) group by 1, 2, 3, 4)
select table1, column1, table2, column2, x.n as distinct1, y.n as distinct2, x.num_rows as rows1, y.num_rows as rows2, y.is_unique as unique2
from common join sizes x on x.tbl = table1 and x.col = column1 join sizes y on y.tbl = table2 and y.col = column2 where common.n = x.n""")
def contained_columns(t: Tables) -> DataFrame:
    """Every column all of whose values occur in another one, whatever the names."""
    return discovery.contained_columns({name: t(name, *columns) for name, columns in MIXED.items()})


# Tables whose key columns are named after the tables they refer to.
TEXTS = {n: STAR[n] for n in ("documents", "labels", "conversations", "benchmark")}


@report("naming_joins", f"""with cells as ({_cells(TEXTS)}),
cols as (select distinct tbl, upper(col) as name, col, regexp_extract(upper(col), '_(ID|CODE|KEY|NO|NUM)$', 1) as ending from cells),
hints as (
  select x.tbl as table1, x.col as column1, y.tbl as table2, y.col as column2 from cols x join cols y
    on x.ending <> '' and x.tbl <> y.tbl and contains(upper(y.tbl), left(x.name, length(x.name) - length(x.ending) - 1)) and length(x.name) > length(x.ending) + 1
    and left(x.name, length(x.name) - length(x.ending) - 1) <> upper(x.tbl)
  where y.name in (x.ending, upper(y.tbl) || '_' || x.ending, x.name)
  qualify row_number() over (partition by x.tbl, x.col, y.tbl order by case y.name when x.ending then 1 when upper(y.tbl) || '_' || x.ending then 2 else 3 end) = 1)
select table1, column1, table2, column2,
  (select count(*) from cells a join cells b on a.value = b.value where a.tbl = table1 and a.col = column1 and b.tbl = table2 and b.col = column2) as common_values,
  (select count(*) from cells where tbl = table1 and col = column1) as distinct1, (select max(cnt) = 1 from cells where tbl = table2 and col = column2) as unique2 from hints""")
def naming_joins(t: Tables) -> DataFrame:
    """References that names suggest, measured: a label's doc_id names the table of documents."""
    tables = {name: t(name, *columns) for name, columns in TEXTS.items()}
    found = discovery.measure_pairs(tables, discovery.naming_hints(TEXTS))
    return found.select("table1", "column1", "table2", "column2", "common_values", "distinct1", "unique2")


LINES = "lines as (select doc_id, source, unnest(string_split(text, chr(10))) as line_text, unnest(generate_series(1, len(string_split(text, chr(10))))) as line from documents)"


@report("search_lines", f"with {LINES} select doc_id, cast(line as bigint) as line, line_text from lines where contains(lower(line_text), 'the')")
def search_lines(t: Tables) -> DataFrame:
    return search.search_lines(t.documents, "doc_id", "text", "THE")


@report("search_lines_regex", f"with {LINES} select doc_id, cast(line as bigint) as line, line_text from lines where regexp_matches(line_text, '(?i)[0-9]{{2,}}|@') and line_text <> ''")
def search_lines_regex(t: Tables) -> DataFrame:
    return search.search_lines(t.documents, "doc_id", "text", "[0-9]{2,}|@", regex=True)


@report("search_objects", f"""with {LINES},
hits as (select doc_id, line, contains(lower(line_text), 'mail') as a, contains(lower(line_text), 'the') as b from lines),
kept as (select doc_id, count(*) as match_count from hits where a or b group by 1 having bool_or(a) and bool_or(b))
select k.doc_id, match_count, string_agg(cast(line as varchar), ',' order by line) as matching_lines
from kept k join (select * from hits where a or b) h on k.doc_id = h.doc_id group by 1, 2""")
def search_objects(t: Tables) -> DataFrame:
    return search.search_objects(t.documents, "doc_id", "text", "MAIL", "THE")


@report("search_sources", """
with source as (select source as owner, lang as type, doc_id as name, unnest(string_split(text, chr(10))) as text, unnest(generate_series(1, len(string_split(text, chr(10))))) as line from documents),
hits as (select *, contains(lower(text), 'mail') as a, contains(lower(text), 'the') as b from source where owner in ('src0', 'src3', 'src7') and type = 'en'),
kept as (select owner, type, name, count(*) as match_count, list_slice(list_sort(list(line)), 1, 100) as lines from hits where a or b group by 1, 2, 3 having bool_or(a) and bool_or(b))
select s.owner, s.type, s.name, match_count, array_to_string(lines, ',') as matching_lines, line, rtrim(s.text, ' ') as text
from source s join kept k on s.owner = k.owner and s.type = k.type and s.name = k.name""")
def search_sources(t: Tables) -> DataFrame:
    """Whole source of the objects of three owners and one type that hold both terms."""
    lines = search.lines_of(t.documents.select(F.struct("source", "lang", "doc_id").alias("k"), "text"), "k", "text")
    source = lines.select(F.col("k.source").alias("owner"), F.col("k.lang").alias("type"), F.col("k.doc_id").alias("name"), "line", F.col("line_text").alias("text"))
    keys = ["owner", "type", "name"]
    objects = search.search_sources(source, keys, "line", "text", "MAIL", "The", within={"owner": ["src0", "src3", "src7"], "type": ["en"]})
    return search.source_of(source, objects, keys, "line", "text").withColumn("matching_lines", F.array_join(F.col("matching_lines").cast("array<string>"), ","))


@report("fetch_objects", f"""with {LINES}
select doc_id, cast(line as bigint) as line, line_text from lines
where doc_id in (select doc_id from labels where quality = 1) and source in ('src1', 'src2', 'src3')""")
def fetch_objects(t: Tables) -> DataFrame:
    """All lines of the documents named in another table, of three owners."""
    names = t.labels.where("quality = 1").select("doc_id")
    return search.fetch_objects(t("documents", "doc_id", "source", "text"), "doc_id", "text", names, "source", ["src1", "src2", "src3"])


@report("search_fields", """
select p_partkey, p_name, p_brand, p_type, concat_ws(',', case when regexp_matches(p_name, '(?i)ring|promo|brand#1') then 'p_name' end, case when regexp_matches(p_brand, '(?i)ring|promo|brand#1') then 'p_brand' end,
  case when regexp_matches(p_type, '(?i)ring|promo|brand#1') then 'p_type' end) as matched_fields from part
where regexp_matches(p_name, '(?i)ring|promo|brand#1') or regexp_matches(p_brand, '(?i)ring|promo|brand#1') or regexp_matches(p_type, '(?i)ring|promo|brand#1')""")
def search_fields(t: Tables) -> DataFrame:
    return search.search_fields(t("part", "p_partkey", "p_name", "p_brand", "p_type"), ["p_name", "p_brand", "p_type"], "ring|promo|brand#1")


def _cells_sql(table: str, key: str, columns: list[str], pattern: str) -> str:
    context = "concat_ws(' | ', " + ", ".join(f"'{c}=' || nullif(cast({c} as varchar), '')" for c in columns) + ")"
    return " union all ".join(
        f"select '{table}' as table_name, cast({key} as varchar) as row_key, {context} as context, '{c}' as field, cast({c} as varchar) as cell from {table} where regexp_matches(cast({c} as varchar), '(?i){pattern}')"
        for c in columns)


CELLS = {"nation": ("n_nationkey", ["n_nationkey", "n_name", "n_regionkey"]), "region": ("r_regionkey", ["r_regionkey", "r_name"]),
         "supplier": ("s_suppkey", ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])}


@report("search_cells", " union all ".join(_cells_sql(t, k, c, "asia|7") for t, (k, c) in CELLS.items()))
def search_cells(t: Tables) -> DataFrame:
    return reduce(DataFrame.unionByName, [search.search_cells(t(n, *c), n, k, "asia|7") for n, (k, c) in CELLS.items()])


def _table_sql(table: str, key: str, columns: list[str], pattern: str) -> str:
    headers = ", ".join(f"('{c}', {i})" for i, c in enumerate(columns))
    return f"""select '{table}' as table_name, 'header' as matched_field, cast(null as varchar) as row_key, h as field, h as cell, 'Header [' || i || ']: ' || h as context
from (select h, i from (values {headers}) v(h, i), (select 1 from {table} limit 1)) where regexp_matches(h, '(?i){pattern}')
union all select table_name, 'cell', row_key, field, cell, context from ({_cells_sql(table, key, columns, pattern)})"""


@report("search_table", " union all ".join(_table_sql(t, k, c, "name|asia|19") for t, (k, c) in CELLS.items()))
def search_table(t: Tables) -> DataFrame:
    """Column names and cells that match, with the row around a cell."""
    return reduce(DataFrame.unionByName, [search.search_table(t(n, *c), n, k, "name|asia|19") for n, (k, c) in CELLS.items()])


TERMS_SQL = "terms as (select word as term, count(*) as uses from (select unnest(string_split(p_name, ' ')) as word from part union all select p_name from part) group by 1)"


@report("tag_terms", f"with {TERMS_SQL} select doc_id, term, uses from documents join terms on contains(lower(text), lower(term))")
def tag_terms(t: Tables) -> DataFrame:
    """Words and whole names of parts as the glossary, their uses as its definitions."""
    words = t.part.select(F.explode(F.split("p_name", " ")).alias("term")).unionByName(t.part.select(F.col("p_name").alias("term")))
    terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("uses"))
    return search.tag_terms(t.documents, "doc_id", "text", terms, "term")


@report("union_canonical", "select 'customer' as origin, c_custkey as party_key, c_name as party_name, c_nationkey as nation_key, c_acctbal as balance, c_mktsegment as segment from customer "
                           "union all select 'supplier', s_suppkey, s_name, s_nationkey, s_acctbal, null from supplier")
def union_canonical(t: Tables) -> DataFrame:
    aliases = {" C_CUSTKEY ": "party_key", "s_suppkey": "party_key", "c_name": "party_name", "S_Name": "party_name", "c_nationkey": "nation_key",
               "s_nationkey": "nation_key", "c_acctbal": "balance", "s_acctbal": "balance", "c_mktsegment": "segment"}
    return search.union_canonical({"customer": t.customer, "supplier": t.supplier}, aliases)
