"""The queries of this package: op<N>_<name> over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dwops.llm import alignment, collocations, cotraining, decontaminate, licenses, masked_lm, near_dedup, packing, substring_dedup, token_counts, token_output, topk, toxicity
from dwops.session import prepare
from dwops.sources.tables import load

# Rows per Arrow batch handed to Python: texts are long, so fewer than Spark's default.
ARROW_ROWS = "512"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def ready(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return prepare(spark)


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(ready(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return fn

    return add


@query("op10_near_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(load(spark, sf_dir, "documents", "doc_id", "text"))


@query("op2_decontaminate", decontaminate.SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents", "doc_id", "text"))


@query("op5_cotraining_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "labels"))


@query("op7_pivot_topk", topk.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(topk.index(load(spark, sf_dir, "embeddings", "vec_id", "embedding")), F.col("vec_id") % 100 == 0)


@query("op9_token_counts")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(load(spark, sf_dir, "documents", "doc_id", "text"))


@query("op3_masked_lm")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.report(load(spark, sf_dir, "documents", "doc_id", "text"))


@query("op6_license_scan", licenses.sql())
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"), licenses.repository_path())


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(load(spark, sf_dir, "documents", "doc_id", "text"))


@query("op13_token_output")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.report(load(spark, sf_dir, "documents", "doc_id", "text"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(load(spark, sf_dir, "documents", "doc_id", "text"))


@query("op12_collocations", collocations.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(load(spark, sf_dir, "documents", "text", "lang"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
