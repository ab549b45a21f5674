"""Incremental and change-driven jobs as Structured Streaming.

Sinks and checkpoints live in the shared folder, so a restarted query goes on where the
last one stopped. All jobs run with ``availableNow``: they take what has arrived, then end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from dwops.operators.loading import upsert
from dwops.streaming import changelog


def file_stream(spark: SparkSession, path: str, schema, ts: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream; ``ts`` becomes a TIMESTAMP, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(path)
    return df.withColumn(ts, F.col(ts).cast("timestamp")) if ts else df


def run_available(writer, checkpoint: str) -> None:
    """Process everything that has arrived, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_summary(stream: DataFrame, ts: str, width: str, aggs: list[Column], path: str, checkpoint: str) -> str:
    """A time-windowed summary kept current by its input; returns where its states are written.

    Each batch replaces the summary as a whole under its own batch number. One row per
    window is kept as state, so ``width`` bounds it.
    """
    windowed = stream.groupBy(F.window(ts, width).alias("_w")).agg(*aggs)
    summary = windowed.select(F.col("_w.start").alias("window_start"), *[c for c in windowed.columns if c != "_w"])

    def replace(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/state={number}")

    run_available(summary.writeStream.outputMode("complete").foreachBatch(replace), checkpoint)
    return path


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The latest state of a summary."""
    states = spark.read.parquet(path)
    return states.where(F.col("state") == states.agg(F.max("state")).scalar()).drop("state")


def stream_sessions(stream: DataFrame, key: str, ts: str, gap: str, watermark: str, path: str, checkpoint: str) -> str:
    """Sessions ended by ``gap`` without action, each written once it can no longer change.

    Sessions still open at the end of the input (their end not passed by the watermark)
    are not written; they come with a later run, and ``open_sessions`` reads them until then.
    """
    sessions = (
        stream.withWatermark(ts, watermark).groupBy(key, F.session_window(ts, gap).alias("_w"))
        .agg(F.count(F.lit(1)).alias("actions"))
    )
    out = sessions.select(
        key, F.col("_w.start").cast("timestamp_ntz").alias("session_start"), F.col("_w.end").cast("timestamp_ntz").alias("session_end"), "actions"
    )
    run_available(out.writeStream.outputMode("append").format("parquet").option("path", path), checkpoint)
    return path


def open_sessions(spark: SparkSession, key: str, checkpoint: str) -> DataFrame:
    """Sessions not yet written by ``stream_sessions``, as its last batch left them in Spark's state store.

    Read between runs, they and the written ones are all sessions of the rows that were taken.
    A session may still grow: its end is that of the rows so far.
    """
    state = spark.read.format("statestore").load(checkpoint)
    ends = lambda side: F.col(f"value.session_window.{side}").cast("timestamp_ntz")
    return state.select(F.col(f"value.{key}").alias(key), ends("start").alias("session_start"), ends("end").alias("session_end"), F.col("value.count").alias("actions"))


def stream_incremental(stream: DataFrame, key: str, path: str, checkpoint: str, buckets: int = changelog.BUCKETS) -> str:
    """Load each new row once, however late it comes.

    The checkpoint remembers the files taken; a row sent again is told by its key among
    those loaded before. The sink lies in folders by bucket of the key and by batch, and a
    batch reads the key column of the buckets its own keys fall into and no others. A batch
    that is run again overwrites its own parts. A NULL key is never a repeat; such rows lie in
    bucket -1, which is never looked up.
    """
    bucket = F.when(F.col(key).isNotNull(), changelog.key_bucket([key], buckets)).otherwise(-1)

    def load(batch: DataFrame, number: int) -> None:
        placed = batch.withColumn("bucket", bucket)
        keyed = placed.where(F.col(key).isNotNull()).dropDuplicates([key])
        if number > 0:
            # At most ``buckets`` numbers.
            touched = [r[0] for r in placed.where("bucket >= 0").select("bucket").distinct().collect()]
            keyed = keyed.join(loaded_keys(batch.sparkSession, path, batch.schema, key, touched, number), ["bucket", key], "left_anti").select(*placed.columns)
        out = keyed.unionByName(placed.where(F.col(key).isNull())).withColumn("batch", F.lit(number).cast("long"))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)

    run_available(stream.writeStream.outputMode("append").foreachBatch(load), checkpoint)
    return path


def loaded_keys(spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: list[int], before: int) -> DataFrame:
    """(bucket, key) of the rows that earlier batches put into the given buckets."""
    known = T.StructType([schema[key], T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
    return spark.read.schema(known).parquet(path).where(F.col("bucket").isin(buckets) & (F.col("batch") < before)).select("bucket", key)


def stream_upsert(stream: DataFrame, keys: list[str], order: list[str], log: str, checkpoint: str, buckets: int = changelog.BUCKETS,
                  fanout: int = changelog.FANOUT) -> str:
    """Collect changes per batch, the winning one per key (first by ``order``); returns the change log.

    Only the changes are written, each batch as a run of the log; full levels of runs are merged
    after each batch (``streaming.changelog``). A batch that is run again overwrites its own run.
    """

    def collect(batch: DataFrame, number: int) -> None:
        changelog.add_batch(batch, number, log, keys, order, buckets)
        changelog.merge_runs(batch.sparkSession, log, keys, order, fanout)

    run_available(stream.writeStream.outputMode("append").foreachBatch(collect), checkpoint)
    return log


def upserted(target: DataFrame, log: str, keys: list[str], update: dict[str, Column] | None = None,
             insert: dict[str, Column] | None = None, order: list[str] = ()) -> DataFrame:
    """The target with the latest change per key merged in: the first by ``order``, as in
    ``stream_upsert``, whichever batch brought it, and of equal ones that of the last batch."""
    changes = changelog.latest_changes(target.sparkSession, log, keys, list(order))
    return target if changes is None else upsert(target, changes, keys, update, insert)
