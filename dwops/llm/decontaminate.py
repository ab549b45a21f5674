"""Benchmark decontamination: one Aho-Corasick automaton over the items' word windows.

Texts are normalised to words (A-Z lowered; digits, letters a-z and all non-ASCII
characters). Every run of ``window`` consecutive item words, or a whole shorter item, is a
pattern. The automaton works on word numbers, so a text is scanned once, word by word, and
a match is a range of words, which maps back to bytes and characters of the original text.

The item set is stated from outside and small beside the corpus. It is read in blocks of
at most ``BLOCK_BYTES`` of text, each broadcast by itself, and a larger set takes one
automaton per block; documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dwops.llm.text import ALNUM, slices, words

WINDOW = 10
BLOCK_BYTES = 4 << 20

HITS = "n_words long, starts array<int>, ends array<int>, items array<string>, from_byte array<long>, to_byte array<long>"


class Automaton:
    """Patterns of word hashes -> the items they come from."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.numbers: dict[int, int] = {}
        found: dict[tuple[int, ...], set[str | None]] = {}
        for first, data, documents in slices(pa.array([t for _, t in items], pa.string())):
            w = words(data, documents, ALNUM)
            for i in range(len(documents) - 1):
                own = [self.numbers.setdefault(h, len(self.numbers) + 1) for h in w.hashes[w.offsets[i] : w.offsets[i + 1]].tolist()]
                for at in range(max(1, len(own) - window + 1)) if own else ():
                    found.setdefault(tuple(own[at : at + window]), set()).add(items[first + i][0])
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, ids in found.items():
            self.machine.add_word(pattern, (len(pattern), ids))
        self.empty = not found
        if found:
            self.machine.make_automaton()
        self.known = np.sort(np.array(list(self.numbers), np.uint64))
        self.number_of_known = np.array([self.numbers[int(h)] for h in self.known], np.int64)

    def scan(self, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged word ranges [start, end) covered by matches, and the items matched."""
        ranges: list[tuple[int, int]] = []
        items: set[str | None] = set()
        if self.empty or not len(hashes):
            return ranges, items
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        sequence = np.where(self.known[at] == hashes, self.number_of_known[at], 0)
        # Only runs of item words can match; a word unknown to the items ends every match.
        known = np.flatnonzero(sequence)
        if not len(known):
            return ranges, items
        breaks = np.flatnonzero(np.diff(known) > 1)
        for a, b in zip(np.r_[known[0], known[breaks + 1]].tolist(), np.r_[known[breaks], known[-1]].tolist()):
            for end, (length, ids) in self.machine.iter(tuple(sequence[a : b + 1].tolist())):
                ranges.append((a + end - length + 1, a + end + 1))
                items |= ids
        return merge(ranges), items


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _automaton(blocks: list[Broadcast], k: int, window: int) -> Automaton:
    """The automaton of block ``k``; a worker process holds one, and keeps it between tasks."""
    for other in blocks[:k] + blocks[k + 1 :]:
        vars(other).pop("machine", None)
    shared = blocks[k]
    if vars(shared).get("machine", (None,))[0] != window:
        shared.machine = (window, Automaton(shared.value, window))
    return shared.machine[1]


def _scan(blocks: list[Broadcast], window: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            hits: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            items: list[set[str | None]] = [set() for _ in range(n)]
            counts = np.zeros(n, np.int64)
            spots: list[tuple[list[int], list[int]]] = [([], []) for _ in range(n)]
            for first, data, documents in slices(batch.column(text_at)) if not blocks else []:
                counts[first : first + len(documents) - 1] = np.diff(words(data, documents, ALNUM).offsets)
            for k in range(len(blocks)):
                machine = _automaton(blocks, k, window)
                for first, data, documents in slices(batch.column(text_at)):
                    w = words(data, documents, ALNUM)
                    for i in range(len(documents) - 1):
                        a, b = w.offsets[i], w.offsets[i + 1]
                        counts[first + i] = b - a
                        found, ids = machine.scan(w.hashes[a:b])
                        if found:
                            hits[first + i] = merge(hits[first + i] + found)
                            items[first + i] |= ids
                            spots[first + i] = (
                                [int(w.starts[a + x] - documents[i]) for x, _ in hits[first + i]],
                                [int(w.ends[a + y - 1] - documents[i]) for _, y in hits[first + i]],
                            )
            named = [sorted(x for x in ids if x is not None) for ids in items]
            added = {
                "n_words": pa.array(counts), "starts": pa.array([[x for x, _ in h] for h in hits], pa.list_(pa.int32())),
                "ends": pa.array([[y for _, y in h] for h in hits], pa.list_(pa.int32())), "items": pa.array(named, pa.list_(pa.string())),
                "from_byte": pa.array([s[0] for s in spots], pa.list_(pa.int64())), "to_byte": pa.array([s[1] for s in spots], pa.list_(pa.int64())),
            }
            kept = [k for k in range(batch.num_columns) if k != text_at]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + list(added.values()), names=[batch.schema.names[k] for k in kept] + list(added))

    return run


def item_blocks(spark: SparkSession, items: DataFrame, id_col: str, text_col: str) -> list[Broadcast]:
    """The items in broadcasts of at most BLOCK_BYTES each (one longer item is a block of its own)."""
    blocks, block, size = [], [], 0
    rows = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    for row in rows.toLocalIterator():
        if block and size + len(row["text"]) > BLOCK_BYTES:
            blocks.append(spark.sparkContext.broadcast(block))
            block, size = [], 0
        block.append((row["id"], row["text"]))
        size += len(row["text"])
    return [*blocks, spark.sparkContext.broadcast(block)] if block else blocks


def find_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, hit word ranges, item ids, byte ranges in the UTF-8 text.

    NULL, empty and wordless texts have no words and no hits; an item without words matches
    nothing. Equal items each count with their own id; an item whose id is NULL marks words
    but is not named. Rows that repeat an id are judged one by one. Without items no row has
    hits; without documents there are no rows. Other columns are ignored.
    """
    blocks = item_blocks(docs.sparkSession, items, item_id, item_text)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_scan(blocks, window, 1), f"doc_id long, {HITS}")


def hit_words() -> Column:
    return F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def report(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """Words, hit words and items per document."""
    found = find_passages(docs, items, **columns)
    return found.select(
        "doc_id", "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("starts") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
          window: int = WINDOW) -> DataFrame:
    """The input rows, all columns, whose texts hold no window of an item."""
    blocks = item_blocks(docs.sparkSession, items, item_id, item_text)
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for k in range(len(blocks)):
                machine = _automaton(blocks, k, window)
                for first, data, documents in slices(batch.column(at)):
                    w = words(data, documents, ALNUM)
                    for i in range(len(documents) - 1):
                        if keep[first + i] and machine.scan(w.hashes[w.offsets[i] : w.offsets[i + 1]])[0]:
                            keep[first + i] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, schema)


SQL = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM documents),
b AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM p),
t AS (SELECT rid, i, k, array_to_string(list_slice(w, i, i + k - 1), ' ') g
      FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT t.rid, t.i, t.k, p.item_id FROM t JOIN p USING (k, g)),
hw AS (SELECT rid, count(DISTINCT x) n_hit FROM (SELECT rid, unnest(range(i, i + k)) x FROM h) GROUP BY rid),
hi AS (SELECT rid, count(*) n_items, string_agg(s, ',' ORDER BY s) ids FROM (SELECT DISTINCT rid, cast(item_id AS varchar) s FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, cast(len(w) AS bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
