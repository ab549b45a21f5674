"""Token counts of documents in flat token files that have no index.

A file is one run of fixed-width ids in which an end-of-document id closes each document.
It is read in blocks that know nothing of documents. Separators of a block are found by
one vectorised comparison; what a block carries over to the next (documents closed so far,
place of the last separator) comes from a prefix scan over block summaries, first within
runs of ``RUN`` blocks and then over the runs. A document may span any number of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dwops.llm.tokens import ID, encoder, share_tokenizer
from dwops.session import fresh_path, stored

END = 50256
WIDTH = 2                 # bytes an id takes: 50,257 ids fit two
BLOCK_IDS = 1 << 17
RUN = 1024

BLOCKS = "file string, block long, data binary"


def _write(shared: Broadcast, end: int, width: int, block_ids: int):
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared)
        name = f"part-{TaskContext.get().partitionId():06d}"
        held, size, block, closed, ids = [], 0, 0, 0, []

        def rows(parts: list[bytes], docs: list, whole: bool):
            nonlocal held, size, block, closed, ids
            data, step = b"".join(parts), block_ids * width
            cut = len(data) if whole else len(data) - len(data) % step
            blocks = [data[i : min(i + step, cut)] for i in range(0, cut, step)] or [b""]
            batch = pa.RecordBatch.from_arrays(
                [pa.array([name] * len(blocks)), pa.array(range(block, block + len(blocks)), pa.int64()), pa.array(blocks, pa.binary()),
                 pa.array([closed] + [0] * (len(blocks) - 1), pa.int64()), pa.array([docs] + [[]] * (len(blocks) - 1), pa.list_(pa.int64()))],
                names=["file", "block", "data", "first", "docs"])
            block, closed, ids, held = block + len(blocks), closed + len(docs), [], [data[cut:]]
            size = len(held[0])
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(encode(text.as_py()) if text.is_valid else b"", ID)
                held.append(np.append(own, ID.type(end)).astype(kind).tobytes())
                ids.append(doc_id)
                size += len(held[-1])
                if size >= block_ids * width:
                    yield rows(held, ids, False)
        if held and (size or ids):
            yield rows(held, ids, True)

    return run


def write_flat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end: int = END,
               width: int = WIDTH, block_ids: int = BLOCK_IDS) -> tuple[DataFrame, DataFrame]:
    """Token files of ``docs``, one per task, and beside them the order in which documents went in.

    Returns (blocks of the files: file, block, data) and (file, document, doc_id). A NULL or
    empty text is a document without tokens.
    """
    spark = docs.sparkSession
    shared = share_tokenizer(spark, tokenizer)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    path = fresh_path(spark, "tokens")
    schema = f"{BLOCKS}, first long, docs array<long>"
    chosen.mapInArrow(_write(shared, end, width, block_ids), schema).write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(schema).parquet(path)
    order = table.where(F.size("docs") > 0).select("file", "first", F.posexplode("docs").alias("k", "doc_id"))
    return table.select("file", "block", "data").where(F.length("data") > 0), order.select("file", (F.col("first") + F.col("k")).alias("document"), "doc_id")


def read_flat(spark: SparkSession, path: str, width: int = WIDTH, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks of binary token files below ``path``; a file is at most what Spark's binary source reads (2 GB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = block_ids * width
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                view = data.as_buffer()
                for block, at in enumerate(range(0, view.size, step)):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([view.slice(at, min(step, view.size - at)).to_pybytes()])],
                                                     names=["file", "block", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, BLOCKS)


def _scan(end: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(d.as_buffer(), f"<u{width}") for d in batch.column(2)]
            found = [np.flatnonzero(x == end).astype(np.int64) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(x) for x in ids], pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["file", "block", "n", "ends"])

    return run


def count_tokens(blocks: DataFrame, end: int = END, width: int = WIDTH) -> DataFrame:
    """file, document (from 0), start, n_tokens (without the separator), ended, per document of each file.

    Blocks of one file must be numbered in order; all ids of a block are whole. Ids after the
    last separator are a document that has not ended. An empty file has no documents; two
    separators in a row enclose a document of no tokens. No blocks give no rows.
    """
    scanned = stored(blocks.select("file", "block", "data").mapInArrow(_scan(end, width), "file string, block long, n long, ends array<long>"))
    run = F.floor(F.col("block") / RUN).alias("run")
    summary = scanned.select("file", run, "block", "n", F.size("ends").cast("long").alias("closed"), F.array_max("ends").alias("last"))
    within = Window.partitionBy("file", "run").orderBy("block")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    # Offsets inside a run of blocks; ``tail`` is the place after the run's last separator so far.
    local = summary.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("closed_before", F.coalesce(F.sum("closed").over(before), F.lit(0)))
    local = local.withColumn("tail", F.max(F.col("at") + F.col("last") + 1).over(before))
    runs = local.groupBy("file", "run").agg(F.sum("n").alias("n"), F.sum("closed").alias("closed"), F.max(F.col("at") + F.col("last") + 1).alias("tail"))
    over_runs = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.withColumn("run_at", F.coalesce(F.sum("n").over(over_runs), F.lit(0)))
    carried = carried.select("file", "run", "run_at", F.coalesce(F.sum("closed").over(over_runs), F.lit(0)).alias("run_closed"),
                             F.coalesce(F.max(F.col("run_at") + F.col("tail")).over(over_runs), F.lit(0)).alias("run_tail"))
    placed = local.join(carried, ["file", "run"]).select(
        "file", "block", (F.col("run_at") + F.col("at")).alias("at"), (F.col("run_closed") + F.col("closed_before")).alias("document"),
        F.coalesce(F.col("run_at") + F.col("tail"), F.col("run_tail")).alias("open_from"))
    joined = scanned.join(placed, ["file", "block"])
    starts = F.transform("ends", lambda e, i: F.when(i == 0, F.col("open_from")).otherwise(F.col("at") + F.get("ends", i - 1) + 1))
    rows = joined.select("file", "document", "at", F.posexplode(F.arrays_zip(F.col("ends").alias("end"), starts.alias("start"))).alias("k", "d"))
    ended = rows.select("file", (F.col("document") + F.col("k")).alias("document"), F.col("d.start").alias("start"),
                        (F.col("at") + F.col("d.end") - F.col("d.start")).alias("n_tokens"), F.lit(True).alias("ended"))
    closing = joined.groupBy("file").agg(F.max(F.col("at") + F.col("n")).alias("size"), F.max(F.col("document") + F.size("ends")).alias("document"),
                                         F.max(F.greatest(F.col("open_from"), F.col("at") + F.array_max("ends") + 1)).alias("start"))
    rest = closing.where("size > start").select("file", "document", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(rest)


def report(docs: DataFrame) -> DataFrame:
    """Token counts of documents, found in the flat files alone; the order of writing gives the ids back."""
    blocks, order = write_flat(docs)
    return order.join(count_tokens(blocks), ["file", "document"]).select("doc_id", "file", "document", "start", "n_tokens")
