"""Token alignment between two tokenizers of the same texts.

Both tokenizers run over the whole text, with a space before it (what they say of a word is kept). Where a token of each ends at
the same byte and a token that begins with a space follows in both, the text is cut: these
anchors are verified shared ends, and between two of them lies a short window, mostly a word.
What a window's ids say (its groups and links) is worked out once per pair of id tuples and kept.

A group is a stretch between two shared ends. A link is an A token and a B token whose bytes
overlap. How many documents hold a link's pair of ids is counted over the corpus: documents
go in blocks of ``BLOCK_BYTES`` of text, each block names its distinct pairs once, the counts
of all blocks are added up, and each block gets the counts of its own pairs back. Rows that
move are pairs per block, not per document, and no block is larger than its text.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, functions as F

from dwops.llm.tokens import Encoder
from dwops.llm.word_ids import BYTE_LEVEL
from dwops.session import stored

BLOCK_BYTES = 8 << 20
WINDOWS_KEPT = 400_000
HIGH = 1 << 31
WORDS_KEPT = 400_000
SPACE = "▁"  # stands for a space in B's pieces

# Texts in which a space is not alone between words, or that hold B's sign for it, go through the tokenizers whole.
_APART = re.compile(f"\\s \\s|  |^ | $|{SPACE}")

CODED = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary, "
         "pairs array<long>, pair_docs array<int>")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Sides:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_file: bytes, b_model: bytes):
        import sentencepiece

        self.a = Encoder(a_file)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        byte_of = {chr(b): b for b in range(256) if b not in BYTE_LEVEL} | {chr(c): b for b, c in BYTE_LEVEL.items()}
        vocabulary = self.a.tokenizer.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in pieces]
        # Neither tokenizer joins anything across a space that stands alone: A cuts before it, and no piece of B goes on behind a space.
        file = json.loads(self.a.tokenizer.to_str())
        cut = file.get("normalizer") is None and (file.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and file["pre_tokenizer"].get("use_regex", True)
        joined = any(SPACE in p.lstrip(SPACE) for _, p in pieces)
        probe = "a b,c \n d"
        self.by_word = cut and not joined and b"".join([self.b_bytes[i] for i in self.b.encode(probe)]) == (" " + probe).encode()
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.digits = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.a_length, self.b_length = (np.array([len(t) for t in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_marked, self.b_marked = (np.array([t[:1] == b" " for t in side]) for side in (self.a_bytes, self.b_bytes))

    def ids(self, text: str) -> tuple[bytes, bytes]:
        """Both sides' ids of the text, 32 bits each; what they say of a word after one space is kept."""
        if not self.by_word or _APART.search(text):
            return self.a(" " + text), array("I", self.b.encode(text)).tobytes()
        words, kept = text.split(" "), self.kept
        found = [kept.get(w) for w in words]
        if None in found:
            new = list({w for w, ids in zip(words, found) if ids is None})
            if len(kept) + len(new) > WORDS_KEPT:
                kept.clear()
                new = list(set(words))
            # New words go through each tokenizer together; a word begins with the one token that holds its space.
            plain = [w for w in new if w and not (w[0].isspace() or w[-1].isspace())]
            joined = " ".join(plain)
            cut = []
            for raw, marked in ((self.a(" " + joined), self.a_marked), (array("I", self.b.encode(joined)).tobytes(), self.b_marked)):
                starts = (4 * np.flatnonzero(marked[np.frombuffer(raw, "<u4")])).tolist()
                cut.append([raw[s:e] for s, e in zip(starts, [*starts[1:], len(raw)])])
            if plain and len(cut[0]) == len(cut[1]) == len(plain):
                kept.update(zip(plain, zip(*cut)))
            for word in new:
                if word not in kept:
                    kept[word] = self.a(" " + word), array("I", self.b.encode(word)).tobytes()
            found = [kept[w] for w in words]
        return b"".join([f[0] for f in found]), b"".join([f[1] for f in found])

    def windows(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """The id tuples of the windows: 32 bits an id, A's before B's, the latter with the highest bit set.

        Ends are taken from the tokens' sizes; whether their bytes are the text's shows when the windows' are put together.
        """
        a_ends, b_ends = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        # How many sides have a token that ends here before one that begins with a space.
        sides_at = np.zeros(max(a_ends[-1], b_ends[-1]) + 1, np.uint8)
        sides_at[a_ends[:-1][self.a_marked[a[1:]]]] = 1
        sides_at[b_ends[:-1][self.b_marked[b[1:]]]] += 1
        a_at = np.concatenate([[0], np.flatnonzero(sides_at[a_ends] == 2) + 1, [len(a)]])
        b_at = np.concatenate([[0], np.flatnonzero(sides_at[b_ends] == 2) + 1, [len(b)]])
        both = np.empty(len(a) + len(b), np.uint32)
        both[np.arange(len(a)) + np.repeat(b_at[:-1], np.diff(a_at))] = a
        both[np.arange(len(b)) + np.repeat(a_at[1:], np.diff(b_at))] = b | np.uint32(HIGH)
        raw, cuts = both.tobytes(), (4 * (a_at + b_at)).tolist()
        return [raw[s:e] for s, e in zip(cuts, cuts[1:])]

    def align(self, window: bytes) -> tuple[bytes | None, str, int, list[int]]:
        """A window's bytes (None where both sides differ), its groups as text, how many, and its links (A id in the upper 32 bits)."""
        ids = memoryview(window).cast("I").tolist()  # small, so plain lists
        a = [x for x in ids if x < HIGH]
        b = [x - HIGH for x in ids[len(a) :]]
        a_tokens, b_tokens = [self.a_bytes[x] for x in a], [self.b_bytes[x] for x in b]
        own = b"".join(a_tokens)
        if not a or not b or own != b"".join(b_tokens):
            return None, "", 0, []
        digits = self.digits
        a_text, b_text = [digits[x] for x in a], [digits[y] for y in b]
        if len(a) == 1 or len(b) == 1:  # a token that covers the window meets all of the other side
            return own, ",".join(a_text) + "|" + ",".join(b_text), 1, [x << 32 | y for x in a for y in b]
        a_ends, b_ends = list(accumulate(map(len, a_tokens))), list(accumulate(map(len, b_tokens)))
        shared = set(a_ends).intersection(b_ends)
        # Between two neighbouring ends of either side lies one link.
        groups, links, i, j, first_a, first_b = [], [], 0, 0, 0, 0
        for end in sorted({*a_ends, *b_ends}):
            links.append(a[i] << 32 | b[j])
            i += a_ends[i] == end
            j += b_ends[j] == end
            if end in shared:
                groups.append(",".join(a_text[first_a:i]) + "|" + ",".join(b_text[first_b:j]))
                first_a, first_b = i, j
        return own, ";".join(groups), len(groups), links


def sides(shared_a: Broadcast, shared_b: Broadcast) -> Sides:
    if not hasattr(shared_a, "sides"):
        shared_a.sides = Sides(shared_a.value, shared_b.value)
    return shared_a.sides


def _code(shared_a: Broadcast, shared_b: Broadcast, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(shared_a, shared_b)
        part, sequence = TaskContext.get().partitionId(), 0
        kept: dict[bytes, int] = {}
        known = kept.get
        spelled: list[bytes | None] = []  # of each kept window: its bytes,
        texts: list[str] = []           # its groups,
        n_groups: list[int] = []        # their number
        links: list[list[int]] = []     # and its links
        rows, seen, size = [], [], 0

        def close() -> pa.RecordBatch:
            """One row a document; the first names the block's distinct pairs and their documents."""
            used, place = np.unique(np.concatenate(seen) if seen else np.zeros(0, np.int64), return_inverse=True)
            own = [links[w] for w in used.tolist()]
            counts = np.array([len(x) for x in own], np.int64)
            flat = np.array([p for x in own for p in x], np.int64)
            pairs, code = np.unique(flat, return_inverse=True)
            starts = np.cumsum(counts) - counts
            docs_of, at, codes_out, times_out = np.zeros(len(pairs), np.int32), 0, [], []
            for row in rows:
                n = row[-1]
                window, times = np.unique(place[at : at + n], return_counts=True)
                at += n
                each = counts[window]
                where = np.repeat(starts[window] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                found, back = np.unique(code[where], return_inverse=True)
                docs_of[found] += 1
                codes_out.append(found.astype("<u4").tobytes())
                times_out.append(np.bincount(back, np.repeat(times, each), len(found)).astype("<u4").tobytes())
            block = part << 32 | sequence
            first = [True] + [False] * (len(rows) - 1)
            longs = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            return pa.RecordBatch.from_arrays(
                [pa.array([block] * len(rows), pa.int64()), *longs, pa.array([r[5] for r in rows]), pa.array(codes_out, pa.binary()), pa.array(times_out, pa.binary()),
                 pa.array([pairs if f else None for f in first], pa.list_(pa.int64())), pa.array([docs_of if f else None for f in first], pa.list_(pa.int32()))],
                names=["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times", "pairs", "pair_docs"])

        def coded(text: str) -> tuple[int, int, list[int]] | None:
            """Numbers of A and B tokens and the windows' codes, or None where either side's bytes are not the text's."""
            a, b = (np.frombuffer(side, "<u4") for side in both.ids(text))
            if not len(a) or not len(b):
                return None
            windows = both.windows(a, b)
            codes = [known(w) for w in windows]
            if None in codes:
                for k, code in enumerate(codes):
                    if code is None:
                        code = known(windows[k])
                        if code is None:
                            code = kept[windows[k]] = len(texts)
                            for column, value in zip((spelled, texts, n_groups, links), both.align(windows[k])):
                                column.append(value)
                        codes[k] = code
            own = [spelled[c] for c in codes]
            return (len(a), len(b), codes) if None not in own and b"".join(own) == (" " + text).encode() else None

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                found = coded(text) if text else None
                if found is None:
                    rows.append((doc_id, 0, 0, 0, 0, "", 0))
                else:
                    n_a, n_b, codes = found
                    total = sum([n_groups[c] for c in codes])
                    digest = hashlib.sha256(";".join([texts[c] for c in codes]).encode()).hexdigest()
                    rows.append((doc_id, n_a, n_b, total, n_a + n_b - total, digest, len(codes)))
                    seen.append(np.array(codes, np.int64))
                size += len(text) + 64
                if size >= block_bytes:
                    yield close()
                    sequence, rows, seen, size = sequence + 1, [], [], 0
                    if len(kept) > WINDOWS_KEPT:  # only here, as an open block refers to them
                        kept.clear()
                        for column in (spelled, texts, n_groups, links):
                            column.clear()
        if rows:
            yield close()

    return run


def _sum(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the corpus-wide counts of its pairs."""
    order = np.argsort(pairs["pair"].to_numpy())
    n, best = pairs["n"].to_numpy()[order], pairs["best"].to_numpy(zero_copy_only=False)[order]
    sums, tops = [], []
    for codes, times in zip(docs["codes"].to_pylist(), docs["times"].to_pylist()):
        code, many = np.frombuffer(codes, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
        sums.append(int((n[code] * many).sum()))
        tops.append(int(many[best[code]].sum()))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(tops, pa.int64())).append_column("count_sum", pa.array(sums, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


def share_models(spark, a_path: str | None = None, b_path: str | None = None) -> tuple[Broadcast, Broadcast]:
    """Both files (a few megabytes each) as broadcasts, so that executors need no copy of their own."""
    import public_tokenizers

    out = []
    for path in (a_path or public_tokenizers.path("byte_bpe_50k.json"), b_path or public_tokenizers.path("piece_bpe_32k.model")):
        with open(path, "rb") as file:
            out.append(spark.sparkContext.broadcast(file.read()))
    return tuple(out)


def code_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None,
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document aligned, its links as codes of its block's pairs; stored."""
    shared = share_models(docs.sparkSession, a_path, b_path)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stored(chosen.mapInArrow(_code(*shared, block_bytes), CODED))


def block_pairs(coded: DataFrame) -> DataFrame:
    """block, pair, docs: distinct linked pairs per block and how many of its documents hold them."""
    return coded.where("pairs is not null").select("block", F.explode(F.arrays_zip("pairs", "pair_docs")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.pair_docs").alias("docs"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """pair, n (documents that hold it), best (n is the highest of its A id); stored."""
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a_id", F.shiftright("pair", 32))
    # One row an A id: bounded by A's vocabulary, whatever the input.
    top = counts.groupBy("a_id").agg(F.max("n").alias("top"))
    return stored(counts.join(F.broadcast(top), "a_id").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))


def id_map(docs: DataFrame, **options) -> DataFrame:
    """a_id, b_id, n, best: which B ids an A id is linked with, and in how many documents."""
    counts = pair_counts(block_pairs(code_documents(docs, **options)))
    return counts.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b_id"), "n", "best")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 per row of ``docs``.

    Texts that are NULL or empty, or that either tokenizer does not give back byte by byte,
    have no tokens: zeros and ''. Rows are documents: repeated ids, repeated texts and rows
    without an id count each. Other columns are ignored. An empty table gives no rows.
    """
    coded = code_documents(docs, **options)
    pairs = block_pairs(coded)
    known = pairs.join(pair_counts(pairs), "pair").select(F.col("block").alias("of_block"), "pair", "n", "best")
    return coded.drop("pairs", "pair_docs").groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_sum, RESULT)
