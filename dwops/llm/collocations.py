"""Phrase collocations from an FM-index per shard over word ids.

Texts are cut into shards of at most ``SHARD_WORDS`` words of one language. A shard's index is
the Burrows-Wheeler transform of its word ids, its suffixes ordered by their first ``DEPTH``
words, which is all that patterns of up to that length need. Words below the least count can
be in no phrase and end a piece, as punctuation does.

Phrases grow a word at a time, all intervals of a shard at once. The words before an interval's
rows, with their counts, are its extensions to the left; the backward step gives each its
interval, which lies inside the interval of the phrase without its last word, of which it is an
extension to the right. So an extension is named by two phrases one word shorter, its first and
its last words, and is only looked at where both are frequent in the whole corpus. Counts are
summed across shards between the lengths; what moves is one row per phrase and shard.

A text longer than a shard goes on in the next one, which begins with the last words of the one
before; an occurrence counts where its last word is new.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from dwops.session import stored

SHARD_WORDS = 1 << 21
DEPTH = 4
LEAST = 30
TOP = 2000
PLACES = 24           # bits of a place in a shard; a shard's number takes those above
SHARDS_A_TASK = 16    # bits of a task's shards in a shard's number
SLICE_BYTES = 4 << 20

# A-Z lowered; what ends a piece becomes a line feed, which no word holds.
_CHANGE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 10)

SHARDS = "shard long, lang string, lead int, ids binary, words array<string>, counts array<long>"
INDEX = "shard long, words int, lead_rows array<int>, bwt binary"
GROWN = "place long, shard long, size int, n long, first long, last long"


class Buffer:
    """The open shard of one language."""

    def __init__(self, lead: list[bytes] = []):
        self.ids: dict[bytes, int] = {b"\n": 0}
        self.parts = [np.array([self.ids.setdefault(w, len(self.ids)) for w in lead], np.int32)]
        self.lead = self.size = len(lead)
        self.tail = lead

    def add(self, words: list[bytes]) -> None:
        ids = self.ids
        self.parts.append(np.array([ids.setdefault(w, len(ids)) for w in words], np.int32))
        self.size += len(words)
        self.tail = (self.tail + words[-DEPTH + 1 :])[-DEPTH + 1 :]

    def row(self, shard: int, lang: str) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        counts = np.bincount(ids[self.lead :], minlength=len(self.ids))[1:]
        words = pa.array(list(self.ids)[1:], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array([shard]), pa.array([lang]), pa.array([self.lead], pa.int32()), pa.array([zstandard.compress(ids.tobytes(), 1)], pa.binary()),
             pa.ListArray.from_arrays([0, len(words)], words), pa.array([counts], pa.list_(pa.int64()))],
            names=["shard", "lang", "lead", "ids", "words", "counts"])


def _slices(data: bytes) -> Iterator[bytes]:
    """A long text in slices that end between words."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        end = max(data.rfind(c, at, at + SLICE_BYTES) for c in (b" ", b"\t", b"\n")) + 1
        if end <= at:  # one word of the whole slice
            found = re.compile(rb"[ \t\n]").search(data, at)
            if not found:
                break
            end = found.end()
        yield data[at:end]
        at = end
    yield data[at:]


def _shards(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(rb"\n|[^ \t\n]+").findall
        part, made, total = TaskContext.get().partitionId(), 0, 0
        open_shards: dict[str, Buffer] = {}

        def close(lang: str) -> pa.RecordBatch:
            nonlocal made, total
            buffer = open_shards.pop(lang)
            total -= buffer.size
            made += 1
            if made >> SHARDS_A_TASK:
                raise ValueError("too many shards in a task: give the table more partitions")
            return buffer.row(part << SHARDS_A_TASK | made - 1, lang)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                for data in _slices(text.as_buffer().to_pybytes().translate(_CHANGE)):
                    words = find(data)
                    while words:
                        buffer = open_shards.setdefault(lang, Buffer())
                        room = max(shard_words - buffer.size, 1)
                        taken, words = words[:room], words[room:]
                        buffer.add(taken)
                        total += len(taken)
                        if buffer.size >= shard_words:
                            before = buffer.tail
                            yield close(lang)
                            lead = before[max((k + 1 for k, w in enumerate(before) if w == b"\n"), default=0) :]
                            if lead:
                                open_shards[lang] = Buffer(lead)
                                total += len(lead)
                if lang in open_shards:
                    open_shards[lang].add([b"\n"])
                    total += 1
                if total > 2 * shard_words:
                    yield close(max(open_shards, key=lambda x: open_shards[x].size))
        for lang in list(open_shards):
            yield close(lang)

    return run


def make_shards(docs: DataFrame, text_col: str, lang_col: str, shard_words: int) -> DataFrame:
    """Shards of all texts: word ids of their own numbering (0 ends a piece), the words and their counts; stored."""
    chosen = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    return stored(chosen.mapInArrow(_shards(shard_words), SHARDS))


def _frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Rows (one per key and shard) of keys with ``least`` occurrences in all shards: a = how many, id = the key's first place."""
    same = Window.partitionBy(*keys)  # at most one row a shard
    return rows.withColumn("a", F.sum("n").over(same)).where(F.col("a") >= least).withColumn("id", F.min("place").over(same))


def frequent_words(shards: DataFrame, least: int) -> DataFrame:
    """(place, shard, k, lang, word, a, id): the frequent words of each shard; stored."""
    words = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("k", "w"))
    words = words.select("shard", "lang", (F.col("k") + 1).alias("k"), F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = words.withColumn("place", F.shiftleft("shard", PLACES).bitwiseOR(F.col("k").cast("long")))
    return stored(_frequent(words, ["lang", "word"], least).drop("n"))


def _index(shards: pa.Table, words: pa.Table) -> pa.Table:
    """A shard's transform over its frequent words, which are numbered by their place in it."""
    ids = np.frombuffer(zstandard.decompress(shards["ids"][0].as_py()), "<i4")
    known = np.sort(words["k"].to_numpy())
    number = np.zeros(shards["known"][0].as_py() + 1, np.int64)
    number[known] = np.arange(1, len(known) + 1)
    text = np.append(number[ids], 0)
    kept = np.append(True, (text[1:] != 0) | (text[:-1] != 0))
    lead = int(kept[: shards["lead"][0].as_py()].sum())
    text = text[kept]
    if text[-1]:
        text = np.append(text, 0)
    # Ranks by the first two words, then by the first four; equal ones stay in order of place.
    rank = text
    for step in (1, 2):
        ahead = np.append(rank[step:], np.zeros(min(step, len(rank)), np.int64))
        pair = rank * (int(rank.max(initial=0)) + 1) + ahead
        if step == 1:
            rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(pair, kind="stable")
    bwt = text[order - 1]  # before the first word stands the last end
    lead_rows = np.flatnonzero(order < lead)
    lead_rows = lead_rows[np.argsort(order[lead_rows])]
    kind = "<u2" if len(known) < 1 << 16 else "<u4"
    return pa.table({"shard": shards["shard"], "words": pa.array([len(known)], pa.int32()), "lead_rows": pa.array([lead_rows], pa.list_(pa.int32())), "bwt": pa.array([bwt.astype(kind).tobytes()], pa.binary())})


def build_index(shards: DataFrame, words: DataFrame) -> DataFrame:
    """shard, words (how many frequent ones), lead_rows (rows of the words taken over from the shard before), bwt; stored."""
    chosen = shards.select("shard", "lead", "ids", F.size("words").alias("known"))
    return stored(chosen.groupBy("shard").cogroup(words.select("shard", "k").groupBy("shard")).applyInArrow(_index, INDEX))


def extend(bwt: np.ndarray, low: np.ndarray, high: np.ndarray, skipped: np.ndarray) -> tuple[np.ndarray, ...]:
    """All extensions of intervals by the word before: (low, size, counted, interval of the first words, interval of the last words).

    Intervals are disjoint and in order. Extensions whose first words have no interval are left
    out. ``skipped`` are rows that do not count; an extension of these alone stays, as a longer one may count.
    """
    backward = np.empty(len(bwt), np.int64)
    backward[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    sizes = high - low
    rows = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    of = np.full(len(bwt), -1, np.int64)
    of[rows] = np.repeat(np.arange(len(low)), sizes)
    rows = rows[bwt[rows] > 0]
    key = of[rows] * (int(bwt.max(initial=0)) + 1) + bwt[rows]
    order = np.argsort(key, kind="stable")
    rows, key = rows[order], key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(key)))
    counts = np.isin(rows, skipped, invert=True).astype(np.int64) if len(skipped) else np.ones(len(rows), np.int64)
    counted = np.add.reduceat(counts, first) if len(first) else np.zeros(0, np.int64)
    to = backward[rows[first]]
    inside = of[to] >= 0
    return to[inside], size[inside], counted[inside], of[to][inside], of[rows[first]][inside]


def _grow(length: int):
    """Phrases of ``length`` words that a shard has, from its frequent ones of a word less."""

    def run(index: pa.Table, known: pa.Table) -> pa.Table:
        if not len(index) or not len(known):
            return pa.table({n: pa.array([], pa.int32() if n == "size" else pa.int64()) for n in ("place", "shard", "size", "n", "first", "last")})
        shard, raw = index["shard"][0].as_py(), index["bwt"][0].as_buffer()
        bwt = np.frombuffer(raw, "<u2" if index["words"][0].as_py() < 1 << 16 else "<u4").astype(np.int64)
        order = np.argsort(known["place"].to_numpy())
        place, ids = known["place"].to_numpy()[order] & ((1 << PLACES) - 1), known["id"].to_numpy()[order]
        if length == 2:  # words: their rows follow those of the ends, in order
            counts = np.bincount(bwt, minlength=len(ids) + 1)
            low = np.cumsum(counts)[:-1]
            high = low + counts[1:]
        else:
            low = place
            high = place + known["size"].to_numpy()[order]
        # Rows whose extension ends among the words taken over from the shard before.
        lead = np.array(index["lead_rows"][0].as_py(), np.int64)
        found, size, n, first, last = extend(bwt, low, high, lead[: max(len(lead) - length + 2, 0)])
        return pa.table({"place": pa.array(found | shard << PLACES), "shard": pa.array(np.full(len(found), shard)), "size": pa.array(size, pa.int32()),
                         "n": pa.array(n, pa.int64()), "first": pa.array(ids[first]), "last": pa.array(ids[last])})

    return run


def grow(index: DataFrame, known: DataFrame, length: int, least: int) -> DataFrame:
    """(place, shard, size, first, last, a, id): frequent phrases of ``length`` words in each shard; stored."""
    grown = index.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(_grow(length), GROWN)
    return stored(_frequent(grown, ["first", "last"], least).drop("n"))


def _score(l: Column, r: Column) -> Column:
    """floor(2000000 a / (l + r)), exact beyond 64 bits."""
    total = l.cast("decimal(20,0)") + r.cast("decimal(20,0)")
    return F.call_function("div", F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(10,0)"), total)


def _cuts(*cuts: tuple[str, str]) -> Column:
    """The lowest-scoring cut, of equal ones the first."""
    return F.array_min(F.array(*[F.struct(_score(F.col(l), F.col(r)).alias("score"), F.lit(k).alias("k"), F.col(l).alias("l"), F.col(r).alias("r"))
                                 for k, (l, r) in enumerate(cuts, 1)]))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP,
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, left_extensions, right_extensions: the first ``top`` phrases of each language.

    NULL texts are empty; a NULL language is ``und``. Repeated rows count as often as they
    occur, ids are not read, other columns are ignored. Ties go to the phrase that is first in
    byte order. Extensions are the frequent phrases with one word more before or behind
    (none for phrases of four words). An empty table, or one without frequent phrases, gives no rows.
    """
    if shard_words + DEPTH >= 1 << (PLACES - 1):
        raise ValueError("a shard is too large")
    shards = make_shards(docs, text_col, lang_col, shard_words)
    # One row a language and shard before the sum.
    totals = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = frequent_words(shards, least)
    index = build_index(shards, words)
    one = words.where("place = id").select("id", "lang", "word", "a")

    found = [grow(index, words.select("shard", "place", "id"), 2, least)]
    for length in (3, 4):
        found.append(grow(index, found[-1].select("shard", "place", "id", "size"), length, least))
    two, three, four = (f.where("place = id").select("id", "first", "last", "a") for f in found)

    def with_parts(longer: DataFrame, shorter: DataFrame, kept_first: dict[str, str], kept_last: dict[str, str]) -> DataFrame:
        first = shorter.select(F.col("id").alias("first"), "lang", F.col("ids").alias("first_ids"), *[F.col(c).alias(n) for n, c in kept_first.items()])
        last = shorter.select(F.col("id").alias("last"), F.element_at("ids", -1).alias("last_id"), *[F.col(c).alias(n) for n, c in kept_last.items()])
        return longer.join(first, "first").join(last, "last").withColumn("ids", F.concat("first_ids", F.array("last_id"))).drop("first_ids", "last_id")

    single = one.withColumn("ids", F.array("id"))
    two = stored(with_parts(two, single, {"f1": "a"}, {"l1": "a"}))
    three = stored(with_parts(three, two, {"f1": "f1", "f2": "a"}, {"l1": "l1", "l2": "a"}))
    four = with_parts(four, three, {"f1": "f1", "f2": "f2", "f3": "a"}, {"l1": "l1", "l2": "l2", "l3": "a"})
    cuts = [_cuts(("f1", "l1")), _cuts(("f1", "l2"), ("f2", "l1")), _cuts(("f1", "l3"), ("f2", "l2"), ("f3", "l1"))]

    # Longer by two words at four fifths of the count, and so is the one between: one word more is enough to look at.
    scored = []
    for level, cut, longer in zip((two, three, four), cuts, (three, four, None)):
        level = level.withColumn("cut", cut)
        if longer is None:
            level = level.withColumns({"left_extensions": F.lit(0).cast("long"), "right_extensions": F.lit(0).cast("long")})
        else:
            sides = longer.select(F.col("last").alias("id"), "a", F.lit(1).alias("left"), F.lit(0).alias("right")).union(
                longer.select(F.col("first").alias("id"), "a", F.lit(0).alias("left"), F.lit(1).alias("right")))
            around = sides.groupBy("id").agg(F.max("a").alias("longest"), F.sum("left").alias("left_extensions"), F.sum("right").alias("right_extensions"))
            level = level.join(around, "id", "left").where(F.col("longest").isNull() | (100 * F.col("longest") < 80 * F.col("a")))
            level = level.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("left_extensions", "right_extensions")})
        scored.append(level.select("id", F.size("ids").alias("words"), "lang", "ids", "a", "cut.l", "cut.r", "cut.score", "left_extensions", "right_extensions"))
    every = scored[0].unionByName(scored[1]).unionByName(scored[2])

    # Words are looked up for the first phrases alone, ties at the end included.
    by_score = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    best = stored(every.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top).drop("place"))
    spelled = best.select("id", "words", F.posexplode("ids").alias("k", "word_id")).join(one.select(F.col("id").alias("word_id"), "word"), "word_id")
    spelled = spelled.groupBy("id", "words").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("in_order"))
    spelled = spelled.select("id", "words", F.array_join(F.col("in_order.word"), " ").alias("phrase"))
    ranked = best.join(spelled, ["id", "words"]).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")))
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "left_extensions", "right_extensions")


def _phrases(k: int) -> str:
    return f"SELECT lang, {k} AS size, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: w[i:i + {k - 1}])) AS p FROM words WHERE len(w) >= {k}"


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
f AS (SELECT lang, size, p, count(*) AS a FROM ({" UNION ALL ".join(_phrases(k) for k in range(1, DEPTH + 1))}) GROUP BY ALL HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
cuts AS (SELECT lang, size, p, a, unnest(range(1, size)) AS k FROM f WHERE size > 1),
scored AS (
  SELECT c.lang, c.size, c.p, c.a, c.k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a + r.a))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.k + 1:]),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (
  SELECT lang, p, a, unnest(flatten(list_transform(range(2, size), lambda j: list_transform(range(1, size - j + 2), lambda i: p[i:i + j - 1])))) AS part FROM f WHERE size > 2),
covered AS (SELECT lang, part, max(a) AS longest FROM inner_parts GROUP BY lang, part)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, array_to_string(s.p, ' ')) AS rank, array_to_string(s.p, ' ') AS phrase,
         s.a, l, r, n::BIGINT AS n, score
  FROM lowest s JOIN totals USING (lang) LEFT JOIN covered c ON c.lang = s.lang AND c.part = s.p
  WHERE c.longest IS NULL OR 100 * c.longest < 80 * s.a)
WHERE rank <= {TOP}
"""
