"""A change log of bounded depth: runs by key bucket, merged level by level.

Each batch adds a run, one folder per key bucket. When ``FANOUT`` runs of a level have come
together they are merged into one of the next level, which keeps the winning change of each
key; so a change is written about once a level and a log of n batches has at most
``FANOUT`` runs in each of log(n) levels. A run is named by the batches it holds and counts
once Spark has marked it complete; a run whose batches a larger one holds no longer counts. A
batch or a merge that is run again therefore overwrites its own folder or is not needed any more.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dwops.operators.relational import top_per_key

BUCKETS = 32
FANOUT = 8


@dataclass(frozen=True, order=True)
class Run:
    first: int
    last: int
    level: int

    def folder(self, log: str) -> str:
        return f"{log}/level={self.level}/run={self.first}-{self.last}"

    def within(self, other: Run) -> bool:
        return self != other and other.first <= self.first and self.last <= other.last and self.level <= other.level


def key_bucket(keys: list[str], buckets: int = BUCKETS) -> Column:
    """The bucket of a key; rows of one key lie in one bucket."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets).cast("long")).cast("int")


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def complete_runs(spark: SparkSession, log: str) -> list[Run]:
    """All runs that were written to their end."""
    pattern, files = _files(spark, f"{log}/level=*/run=*/_SUCCESS")
    out = []
    for status in files.globStatus(pattern) or []:
        run = status.getPath().getParent()
        first, last = run.getName().removeprefix("run=").split("-")
        out.append(Run(int(first), int(last), int(run.getParent().getName().removeprefix("level="))))
    return sorted(out)


def live_runs(spark: SparkSession, log: str) -> list[Run]:
    """The runs that together hold every batch once, oldest first."""
    runs = complete_runs(spark, log)
    return [r for r in runs if not any(r.within(other) for other in runs)]


def _write(changes: DataFrame, log: str, run: Run) -> None:
    # A bucket too large for one task is written by several.
    changes.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(run.folder(log))


def add_batch(batch: DataFrame, number: int, log: str, keys: list[str], order: list[str], buckets: int = BUCKETS) -> None:
    """The winning change of each key of a batch as a run of its own, unless a merged run holds the batch already."""
    mine = Run(number, number, 0)
    if any(mine.within(r) for r in complete_runs(batch.sparkSession, log)):
        return
    last = top_per_key(batch, keys, order, 1).drop("_rn")
    _write(last.withColumns({"bucket": key_bucket(keys, buckets), "batch": F.lit(number).cast("long")}), log, mine)


def _holds_rows(spark: SparkSession, log: str, run: Run) -> bool:
    pattern, files = _files(spark, f"{run.folder(log)}/bucket=*")
    return bool(files.globStatus(pattern))


def read_runs(spark: SparkSession, log: str, runs: list[Run], only: list[int] | None = None) -> DataFrame | None:
    """Changes of the given runs, of some buckets alone if ``only`` names them; None if no run holds a row."""
    folders = [r.folder(log) for r in runs if _holds_rows(spark, log, r)]
    if not folders:
        return None
    found = spark.read.option("basePath", log).parquet(*folders).drop("level", "run")
    return found if only is None else found.where(F.col("bucket").isin(only))


def _latest(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return top_per_key(changes, keys, [*order, "-batch"], 1).drop("_rn")


def _merge(spark: SparkSession, log: str, runs: list[Run], level: int, keys: list[str], order: list[str]) -> None:
    changes = read_runs(spark, log, runs)
    changes = spark.createDataFrame([], "bucket int, batch long") if changes is None else _latest(changes, keys, order)
    _write(changes, log, Run(min(r.first for r in runs), max(r.last for r in runs), level))


def merge_runs(spark: SparkSession, log: str, keys: list[str], order: list[str], fanout: int = FANOUT) -> int:
    """Merge levels that have ``fanout`` live runs into the next; returns how many merges that took."""
    merges = 0
    while True:
        live = live_runs(spark, log)
        full = next((level for level in sorted({r.level for r in live}) if sum(r.level == level for r in live) >= fanout), None)
        if full is None:
            return merges
        # All live runs of the level and below it, so that a run's batches stay next to each other.
        chosen = [r for r in live if r.level <= full]
        _merge(spark, log, chosen, full + 1, keys, order)
        merges += 1


def compact(spark: SparkSession, log: str, keys: list[str], order: list[str], remove: bool = False) -> None:
    """Merge everything into one run, a folder per bucket; ``remove`` deletes the runs it holds.

    Only remove runs when nobody reads the log at the time.
    """
    live = live_runs(spark, log)
    if len(live) > 1:
        _merge(spark, log, live, max(r.level for r in live) + 1, keys, order)
    if remove:
        runs = complete_runs(spark, log)
        for run in [r for r in runs if any(r.within(other) for other in runs)]:
            path, files = _files(spark, run.folder(log))
            files.delete(path, True)


def latest_changes(spark: SparkSession, log: str, keys: list[str], order: list[str], wanted: DataFrame | None = None,
                   buckets: int = BUCKETS) -> DataFrame | None:
    """The winning change per key: the first by ``order``, of equal ones that of the last batch; None without changes.

    With ``wanted`` (rows of keys) only the buckets these fall into are read, and only their
    keys are returned. The driver sees bucket numbers, at most ``buckets`` of them.
    """
    only = None
    if wanted is not None:
        wanted = wanted.select(*keys).distinct()
        only = [r[0] for r in wanted.select(key_bucket(keys, buckets).alias("b")).distinct().collect()]
    changes = read_runs(spark, log, live_runs(spark, log), only)
    if changes is not None and wanted is not None:
        changes = changes.join(wanted, keys, "left_semi")
    return None if changes is None else _latest(changes, keys, order).drop("batch", "bucket")
