"""Best-fit packing of token sequences with large-item matching.

A bin (sequence) holds ``capacity`` tokens. Documents longer than that are cut into full
pieces, which fill a bin each, and a first one that may be shorter. Of pieces longer than a third of the
capacity at most two fit one bin: greedily, from the longest down, each is matched with the
longest other one that still fits. Shorter pieces go, from the longest down, into the
fullest bin that still has room (best fit), or a new bin.

The plan depends only on how many pieces have each length, which is ``capacity`` numbers.
It is made for runs of equal bins at once, so it is small at any number of documents. Each
piece then finds its place from its number among the pieces of its length. These numbers
come from counts per written part, not from one sort of all pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from dwops.llm.tokens import ID, encoder, share_tokenizer
from dwops.session import stored

CAPACITY = 1024
END_OF_DOCUMENT = 2
TEXT_BYTES = 4 << 20


def _cut(shared: Broadcast, capacity: int, end_id: int):
    """doc_id, text -> pieces with their number among the task's pieces of the same length."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(shared), defaultdict(int)
        end = np.array([end_id], ID).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = memoryview((encode(text.as_py()) if text.is_valid else b"") + end)
                n = len(ids) // ID.itemsize
                # What is over goes into the first piece, the others are full.
                over = (n - 1) % capacity + 1
                for piece, (start, length) in enumerate([(0, over), *((s, capacity) for s in range(over, n, capacity))]):
                    part = ids[start * ID.itemsize : (start + length) * ID.itemsize]
                    rows.append((doc_id, piece, start, length, zlib.crc32(part), seen[length]))
                    seen[length] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "number"])

    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, number long"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first, last, bin, each, offset).

    Pieces numbered ``first`` to ``last`` (not included) of that length lie in bins from
    ``bin`` on, ``each`` of them side by side from ``offset`` in every bin.
    """
    placed: list[tuple[int, int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    bins = 0
    # Runs of equal bins: (room, first bin, how many), in order of room.
    open_runs: list[tuple[int, int, int]] = []

    def put(length: int, first_bin: int, n_bins: int, each: int, offset: int) -> None:
        placed.append((length, used[length], used[length] + n_bins * each, first_bin, each, offset))
        used[length] += n_bins * each

    def take(length: int, n: int) -> None:
        left[length] -= n
        if not left[length]:
            del left[length]

    def opened(room: int, first_bin: int, n: int) -> None:
        if n and room:
            insort(open_runs, (room, first_bin, n))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        longest = large[-1]
        partners = bisect_right(large, capacity - longest)
        partner = large[partners - 1] if partners else None
        if partner is None:
            n = left[longest]
            put(longest, bins, n, 1, 0)
            take(longest, n)
            opened(capacity - longest, bins, n)
        elif partner == longest:
            pairs, odd = divmod(left[longest], 2)
            if pairs:
                put(longest, bins, pairs, 2, 0)
                take(longest, 2 * pairs)
                opened(capacity - 2 * longest, bins, pairs)
                bins += pairs
            if odd:
                shorter = [x for x in large if x < longest]
                if shorter:
                    put(longest, bins, 1, 1, 0)
                    take(longest, 1)
                    put(shorter[-1], bins, 1, 1, longest)
                    take(shorter[-1], 1)
                    opened(capacity - longest - shorter[-1], bins, 1)
                else:
                    put(longest, bins, 1, 1, 0)
                    take(longest, 1)
                    opened(capacity - longest, bins, 1)
            n = odd
        else:
            n = min(left[longest], left[partner])
            put(longest, bins, n, 1, 0)
            put(partner, bins, n, 1, longest)
            take(longest, n)
            take(partner, n)
            opened(capacity - longest - partner, bins, n)
        bins += n
        large = [x for x in large if x in left]

    for length in sorted(left, reverse=True):
        n = left.pop(length)
        while n:
            at = bisect_right(open_runs, (length, -1, 0))
            if at == len(open_runs):  # nothing has room: new bins, filled below
                room, first_bin, many = capacity, bins, -(-n // (capacity // length))
                bins += many
            else:
                room, first_bin, many = open_runs.pop(at)
            each = room // length
            full = min(many, n // each)
            if full:
                put(length, first_bin, full, each, capacity - room)
                opened(room - each * length, first_bin, full)
                n -= full * each
            if full < many:
                rest = min(n, each) if full < many else 0
                if rest:
                    put(length, first_bin + full, 1, rest, capacity - room)
                    opened(room - rest * length, first_bin + full, 1)
                    n -= rest
                    full += 1
                if full < many:
                    opened(room, first_bin + full, many - full)
    return placed


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY,
         end_id: int = END_OF_DOCUMENT) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's tokens are its text's ids and the end id. NULL and empty texts are the end
    id alone. Every input row is packed, also rows that repeat an id or have none; equal texts
    are packed as often as they occur. Pieces of equal length are numbered in the order in
    which they were written. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    shared = share_tokenizer(spark, tokenizer)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    cut = chosen.mapInArrow(_cut(shared, capacity, end_id), PIECES)
    # Written once: the numbers below hold for these rows, whichever task is run again.
    pieces = stored(cut.withColumn("part", F.spark_partition_id()))

    per_part = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    # At most ``capacity`` rows, whatever the input.
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.createDataFrame(plan(counts, capacity), "length long, first long, last long, bin long, each long, at long")

    numbered = pieces.join(shifts, ["length", "part"]).withColumn("number", F.col("number") + F.col("shift")).drop("shift", "part")
    inside = (numbered["length"] == places["length"]) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last"))
    # The plan's rows are bounded by the capacity, not by the data.
    found = numbered.join(F.broadcast(places), inside).drop(places["length"])
    rank = F.col("number") - F.col("first")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("bin") + F.floor(rank / F.col("each"))).alias("sequence_id"),
        (F.col("at") + rank % F.col("each") * F.col("length")).alias("offset"),
    )
