"""Token ids of a corpus as binary files: canonical Huffman codes in independent blocks.

Ids are counted over all documents first, and one length-limited Huffman code is made from
the counts. Documents go out in ascending order of their id, in files of about ``FILE_IDS``
ids. A file (little-endian) holds

    magic, version, number of symbols, documents, ids, blocks, part, sequence, crc32 of the coded bytes
    zlib of the code lengths (one byte a symbol: the canonical code)
    zlib of the documents' ids (64 bits), which of them are NULL, and their lengths (64 bits)
    bit offset of every block of 256 ids (64 bits)
    the coded ids

so that any block of any file is decoded without the ones before it (``read_block``). Tasks
write files under names of their own attempt; a list of the names, which Spark commits, says
which count, so a lost executor or a second attempt leaves at most a file nobody reads.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dwops.llm.huffman import BLOCK, LIMIT, Code, code_lengths
from dwops.llm.word_ids import END_OF_DOCUMENT, share_words, word_encoder
from dwops.session import fresh_path, stored

FILE_IDS = 1 << 21
MAGIC, VERSION = b"TOKENIDS", 1
HEAD = "<8sIIQQQIIIII"
ROWS = "doc_id long, n_tokens long, ids_crc32 long, at long, ids binary"


def width(symbols: int) -> str:
    """Two bytes an id where all symbols fit, else four."""
    return "<u2" if symbols <= 1 << 16 else "<u4"


def _encode(shared: Broadcast, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = word_encoder(shared), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            whole = [(encode(t.as_py()) if t.is_valid else b"") + end for t in batch.column(1)]
            narrow = [np.frombuffer(x, "<u4").astype(kind).tobytes() for x in whole]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in whole], pa.int64()), pa.array([zlib.crc32(x) for x in whole], pa.int64()),
                 pa.array(range(at, at + len(whole)), pa.int64()), pa.array(narrow, pa.binary())],
                names=["doc_id", "n_tokens", "ids_crc32", "at", "ids"])
            at += len(whole)

    return run


def token_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
               end_id: int = END_OF_DOCUMENT) -> tuple[DataFrame, int]:
    """(doc_id, n_tokens, ids_crc32, part, at, ids) of every row, stored, and the number of symbols.

    NULL and empty texts are the end id alone. ``ids`` takes two bytes an id where all ids of the vocabulary fit, else four.
    """
    spark = docs.sparkSession
    shared = share_words(spark, tokenizer)
    symbols = max(word_encoder(shared).size, end_id + 1)
    kind = width(symbols)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(chosen.mapInArrow(_encode(shared, end_id, kind), ROWS).withColumn("part", F.spark_partition_id())), symbols


def id_counts(rows: DataFrame, symbols: int) -> np.ndarray:
    """How often each id occurs in all rows; the driver gets one number a symbol."""
    kind = width(symbols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(symbols, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                found, n = np.unique(np.frombuffer(ids.as_buffer(), kind), return_counts=True)
                sums[found] += n
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen], pa.int64())], names=["id", "n"])

    counts = np.zeros(symbols, np.int64)
    for row in rows.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row["id"]] = row["n"]
    return counts


def pack_file(code: Code, doc_ids: list, ids: list[np.ndarray], part: int, sequence: int) -> bytes:
    """One file's bytes."""
    data, offsets = code.encode(np.concatenate(ids))
    lengths = zlib.compress(code.lengths.tobytes())
    table = zlib.compress(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes()
                          + np.array([len(x) for x in ids], "<u8").tobytes())
    head = struct.pack(HEAD, MAGIC, VERSION, len(code.lengths), len(doc_ids), sum(map(len, ids)), len(offsets), part, sequence, zlib.crc32(data), len(lengths), len(table))
    return b"".join([head, lengths, table, offsets.astype("<u8").tobytes(), data])


class TokenFile:
    """One file's parts. ``codes`` keeps the code of the last file, which files of one writing share."""

    def __init__(self, content: bytes | memoryview, codes: dict[bytes, Code] | None = None):
        magic, version, symbols, docs, self.n, blocks, self.part, self.sequence, crc, n_lengths, n_table = struct.unpack_from(HEAD, content)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token id file")
        at = struct.calcsize(HEAD)
        lengths = bytes(content[at : at + n_lengths])
        at += n_lengths
        table = zlib.decompress(content[at : at + n_table])
        at += n_table
        self.offsets = np.frombuffer(content, "<u8", blocks, at)
        self.data = np.frombuffer(content, np.uint8, offset=at + 8 * blocks)
        if zlib.crc32(self.data) != crc:
            raise ValueError("token id file is damaged")
        missing = np.frombuffer(table, np.uint8, docs, 8 * docs)
        self.doc_ids = [None if m else d for d, m in zip(np.frombuffer(table, "<i8", docs).tolist(), missing)]
        self.lengths = np.frombuffer(table, "<u8", docs, 9 * docs).astype(np.int64)
        codes = {} if codes is None else codes
        if lengths not in codes:
            codes.clear()
            codes[lengths] = Code(np.frombuffer(zlib.decompress(lengths), np.uint8, symbols))
        self.code = codes[lengths]

    def ids(self) -> np.ndarray:
        return self.code.decode(self.data, self.offsets, self.n)

    def read_block(self, block: int) -> np.ndarray:
        """Ids ``256 * block`` and on, without any other block."""
        return self.code.decode(self.data, self.offsets, self.n, block, block + 1)


def _write(folder: str, lengths: np.ndarray, file_ids: int):
    kind = width(len(lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        code, part, sequence = Code(lengths), TaskContext.get().partitionId(), 0
        doc_ids, ids, size = [], [], 0

        def close() -> pa.RecordBatch:
            name = f"{part:06d}-{sequence:06d}-{uuid4().hex}.ids"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(pack_file(code, doc_ids, ids, part, sequence))
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([part], pa.int64()), pa.array([sequence], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([size], pa.int64())],
                names=["name", "part", "sequence", "docs", "ids"])

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids.append(doc_id)
                ids.append(np.frombuffer(own.as_buffer(), kind))
                size += len(ids[-1])
                if size >= file_ids:
                    yield close()
                    sequence, doc_ids, ids, size = sequence + 1, [], [], 0
        if doc_ids:
            yield close()

    return run


FILES = "name string, part long, sequence long, docs long, ids long"


def write_ids(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
              end_id: int = END_OF_DOCUMENT, limit: int = LIMIT, file_ids: int = FILE_IDS) -> str:
    """Write all documents' ids below ``folder`` (default: a new one in the shared folder) and return it.

    Documents come in ascending order of their id, rows without one first; rows of one id by
    number of ids, then by checksum, so equal inputs give equal files whatever their order.
    The sort has the rows' place as its last key, so an id of a third of all rows is spread
    over tasks. A document is never cut: a file ends with the document that fills it. An
    empty table gives a folder without token files.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "ids")
    folder = folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder)
    rows, symbols = token_rows(docs, id_col, text_col, tokenizer, end_id)
    lengths = code_lengths(id_counts(rows, symbols), limit)
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(f"{root}/data", recursive=True)
    order = ["doc_id", "n_tokens", "ids_crc32", "part", "at"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")
    ordered.mapInArrow(_write(f"{folder}/data", lengths, file_ids), FILES).write.parquet(f"{folder}/files")
    return folder


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes: dict[bytes, Code] = {}
    for batch in batches:
        for content, before in zip(batch.column(0), batch.column(1).to_pylist()):
            file = TokenFile(memoryview(content.as_buffer()), codes)
            ids = file.ids()
            ends = np.cumsum(file.lengths)
            starts = ends - file.lengths
            for k in range(0, len(starts), 512):
                own = [ids[s:e].astype("<u4").tobytes() for s, e in zip(starts[k : k + 512], ends[k : k + 512])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids[k : k + 512], pa.int64()), pa.array(starts[k : k + 512] + before), pa.array(file.lengths[k : k + 512]), pa.array(own, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, 32 bits each) from the files of ``write_ids``."""
    files = spark.read.schema(FILES).parquet(f"{folder}/files")
    parts = files.groupBy("part").agg(F.sum("ids").alias("ids"))  # one row a sort partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before_part = parts.select("part", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before_part"))
    within = Window.partitionBy("part").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("name", "part", F.coalesce(F.sum("ids").over(within), F.lit(0)).alias("within")).join(before_part, "part")
    placed = placed.select("name", (F.col("before_part") + F.col("within")).alias("before"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(f"{folder}/data")
    content = content.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    # Files of attempts that were given up are not in the list.
    return content.join(placed, "name").select("content", "before").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, as read back from the written files.

    NULL and empty texts have one id, the end. Repeated and NULL ids keep one row each. Other
    columns are ignored. An empty table gives no rows.
    """
    found = read_ids(docs.sparkSession, write_ids(docs, **options))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
