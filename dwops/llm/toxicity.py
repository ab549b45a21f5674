"""Toxicity by gradient-boosted trees over dense text features, with isotonic calibration.

A lexicon of terms (whole words and word beginnings) is learned from labelled rows by their
smoothed log odds, beside a short fixed one. Features of a text: lexicon densities, how near
a hit stands to a second-person word, capitals, punctuation and obfuscation rates. Labels
are the only supervision; language, source and id are no inputs.

Fitting uses at most ``SAMPLE`` labelled rows, those with the smallest hash of their id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from dwops.llm.models import BoostedTrees, Isotonic, set_aside

SAMPLE = 8_000
TERMS = 500
LEAST_TOXIC = 5      # toxic rows a learned term occurs in
LEAST_ODDS = 2.5     # natural logarithm
PREFIXES = (4, 5)
STRONG = 3.0

# A short list of common insults, and second-person words.
INSULTS = ["clown", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless"]
SECOND_PERSON = {"you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "vous", "votre", "usted", "ustedes", "ti", "tus"}

WORD = re.compile(r"[^\W_](?:[^\s]*[^\W_])?")
LETTERS = re.compile(r"[^\W\d_]+")
LEET = str.maketrans("013457@$!|", "oleastasil")
_RUN = re.compile(r"([^\W\d_])\1\1")
_MIXED = re.compile(r"[^\W\d_][0-9@$*!|#%&]+[^\W\d_]")
_MARKS = re.compile(r"[!?]")
_PUNCTUATION = re.compile(r"[^\w\s]")
_CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SHOUTED = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")


def terms(word: str) -> list[str]:
    """The word itself and its beginnings (marked with *)."""
    return [word, *[word[:n] + "*" for n in PREFIXES if len(word) > n]]


class Lexicon(dict):
    """word -> log odds of its strongest term, kept per word (at most ``KEPT`` of them)."""

    KEPT = 200_000

    def __init__(self, odds: dict[str, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str) -> float:
        if len(self) > self.KEPT:
            self.clear()
        self[word] = value = max(self.odds.get(t, 0.0) for t in terms(word))
        return value


def features(text: str, lexicon: Lexicon) -> list[float]:
    lowered = text.lower()
    words = LETTERS.findall(lowered)
    odds = [lexicon[w] for w in words]
    n, chars = max(len(words), 1), max(len(text), 1)
    hits = [i for i, o in enumerate(odds) if o >= STRONG]
    mild = sum(1 for o in odds if 0 < o < STRONG)
    near = 0.0
    seconds = 0
    if SECOND_PERSON.intersection(words):
        second = np.array([i for i, w in enumerate(words) if w in SECOND_PERSON])
        seconds = len(second)
        if hits:
            spots = np.searchsorted(second, hits)
            after = np.abs(second[np.minimum(spots, seconds - 1)] - hits)
            before = np.abs(second[np.maximum(spots - 1, 0)] - hits)
            near = float((1 / (1 + np.minimum(after, before))).max())
    mixed = _MIXED.findall(lowered)
    disguised = sum(1 for w in WORD.findall(lowered) if lexicon[w.translate(LEET)] >= STRONG) if mixed else 0
    capitals = len(_CAPITALS.findall(text))
    return [
        np.log1p(n), len(hits) / n, np.log1p(len(hits)), max(odds, default=0.0), sum(odds) / n, mild / n, near, seconds / n,
        capitals / chars, len(_SHOUTED.findall(text)) / n, len(_MARKS.findall(text)) / chars, len(_PUNCTUATION.findall(text)) / chars,
        len(mixed) / n, np.log1p(disguised), sum(1 for _ in _RUN.finditer(lowered)) / n,
    ]


class Model:
    """Lexicon, trees and calibration. Steps of the calibration keep a trace of the trees' order."""

    def __init__(self, odds: dict[str, float], trees: BoostedTrees, steps: Isotonic | None):
        self.odds, self.trees, self.steps = odds, trees, steps

    def score(self, x: np.ndarray) -> np.ndarray:
        p = self.trees.score(x)
        return 0.98 * self.steps(p) + 0.02 * p if self.steps else p


def labelled_sample(labels: DataFrame, id_col: str, label: str, rows: int, where: Column | None = None) -> DataFrame:
    """At most ``rows`` distinct ids with a 0/1 label, those of smallest hash; a local table.

    Rows whose id or label is NULL are left out; of several labels of one id the largest holds.
    """
    spark = labels.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    known = known if where is None else known.where(where)
    chosen = known.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(rows)
    return spark.createDataFrame([tuple(r) for r in chosen.collect()], "id long, y int")


def learn_terms(texts: DataFrame) -> dict[str, float]:
    """Log odds of the terms most telling of toxic rows; counted by Spark, ``TERMS`` of them kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, toxic = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = {t for w in set(LETTERS.findall((text or "").lower())) for t in terms(w)}
                found += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(toxic, pa.int32())], names=["term", "y"])

    rows = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = rows.get(1, 0), rows.get(0, 0)
    counts = texts.select("text", "y").mapInArrow(run, "term string, y int").groupBy("term").agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n"))
    odds = F.log((F.col("t") + 0.1) / (n1 + 0.2)) - F.log((F.col("n") - F.col("t") + 0.1) / (n0 + 0.2))
    best = counts.where(F.col("t") >= LEAST_TOXIC).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    learned = {r["term"]: r["odds"] for r in best.orderBy(F.desc(F.col("odds") * F.sqrt("t")), "term").limit(TERMS).collect()}
    return {w: max(STRONG, learned.get(w, 0.0)) for w in INSULTS} | {t: o for t, o in learned.items() if t not in INSULTS}


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE,
        where: Column | None = None) -> Model:
    """Fit on at most ``sample`` labelled rows of ``docs``; ``where`` restricts labels by ``id``."""
    ids = labelled_sample(labels, id_col, label, sample, where)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # The sample's bound bounds the broadcast and, with one row an id, what comes back.
    chosen = texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y")
    odds = learn_terms(chosen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(odds)
        for batch in batches:
            x = [features(t or "", lexicon) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["id", "y", "x"])

    rows = sorted(chosen.select("id", "text", "y").mapInArrow(run, "id long, y int, x array<double>").collect())
    x, y = np.array([r["x"] for r in rows], float).reshape(len(rows), len(features("", Lexicon({})))), np.array([r["y"] for r in rows], float)
    aside = set_aside([r["id"] for r in rows], y)
    trees = BoostedTrees().fit(x[~aside], y[~aside])
    steps = Isotonic().fit(trees.score(x[aside]), y[aside]) if aside.any() and trees.nodes else None
    return Model(odds, trees, steps)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every input row, whole texts.

    NULL and empty texts get the score of a text without words; rows that repeat an id are
    scored one by one; a NULL id stays NULL. Without usable labels, or labels of one class,
    the score is the class's share. Other columns are ignored.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.odds)
        for batch in batches:
            if len(batch):
                x = np.array([features(t.as_py() or "", lexicon) for t in batch.column(1)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.clip(model.score(x), 0, 1))], names=["doc_id", "score"])

    return chosen.mapInArrow(run, "doc_id long, score double")


def held_out(id_col: str) -> Column:
    """Rows kept from learning: the CRC of the id's text divisible by five."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels, where=~held_out("id"))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
