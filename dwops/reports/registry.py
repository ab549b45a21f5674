"""Registry of reports: name -> (query, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Report:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REPORTS: dict[str, Report] = {}


class Tables:
    """Tables of one data directory, by attribute or with a column list."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self(name)

    def __call__(self, name: str, *columns: str) -> DataFrame:
        from dwops.sources.tables import load

        return load(self.spark, self.directory, name, *columns)


def report(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in REPORTS:
            raise ValueError(f"report {name!r} is registered twice")
        REPORTS[name] = Report(lambda spark, directory: fn(Tables(spark, directory)), sql)
        return fn

    return add
