"""Every report against its SQL in DuckDB, and ordered ones again with tiny chunks."""

import pytest

import __spark_entry__ as entry
from tests.check import compare, duck
from dwops.plans.ordered import CHUNK_ROWS_KEY

SF = "/root/testdata/sf0.001"
# The reports; the training-data queries have tests of their own.
QUERIES = {n: q for n, q in entry.queries().items() if n in entry.REPORTS}
SQL = {n: q for n, q in entry.oracle_sql().items() if n in entry.REPORTS}

# Reports whose groups may be cut.
ORDERED = [
    "scd2_asof_join", "row_number", "ranking", "ntile", "running_total_range", "running_total_rows", "running_qty_by_part", "time_gaps",
    "sessionize", "percent_rank", "filtered_window", "category_rank", "sequence_gaps", "interval_overlap", "percentiles", "surrogate_keys",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_report_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_report(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) == []


@pytest.mark.parametrize("name", ORDERED)
def test_report_with_cut_groups(spark, con, name):
    spark.conf.set(CHUNK_ROWS_KEY, "40")
    try:
        assert compare(QUERIES[name](spark, SF), con, SQL[name]) == []
    finally:
        spark.conf.unset(CHUNK_ROWS_KEY)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["n_name", "year", "revenue", "cumulative_revenue", "pct_of_year"]
    assert df.count() > 0
