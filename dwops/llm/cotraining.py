"""Quality classifier by co-training of a text view and a page-metadata view.

The text view sees only the text: boosted trees over measures of its words, lines and
characters. The metadata view sees only language, source and declared length: a logistic
regression over hashed indicators. Both start from the labelled sample. In each round every
view labels the rows of an unlabelled pool of which it is confident, and these go to the
other view's training set. A view's confidence is its calibrated probability, so that a view
that cannot tell hands on nothing. At the end both calibrated views are combined by a
logistic regression fitted on labelled rows that neither was trained on.

Fitting uses at most ``SAMPLE`` labelled and ``POOL`` unlabelled rows, those with the smallest
hash of their id. Scoring covers all rows in one pass without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dwops.llm.models import BoostedTrees, Logistic, set_aside
from dwops.llm.toxicity import labelled_sample

SAMPLE = 8_000
POOL = 8_000
ROUNDS = 3
CONFIDENT = 0.97
HANDED = 400          # rows a view hands on per round, the most confident ones first
SOURCES, LANGUAGES = 64, 16

_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_MARK = re.compile(r"[!?]")
_STOP = re.compile(r"[.,;:]")
_DIGIT = re.compile(r"[0-9]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_RUN = re.compile(r"(\S)\1{3,}")


def text_features(text: str) -> list[float]:
    words = text.split()
    lines = text.split("\n")
    n, chars = max(len(words), 1), max(len(text), 1)
    kinds = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lengths = np.fromiter(map(len, words), float, len(words)) if words else np.zeros(1)
    sentences = [s for s in re.split(r"[.\n]", text) if s.strip()]
    return [
        np.log1p(len(words)), lengths.mean(), lengths.std(), float(lengths.max()), len(kinds) / n, (kinds.most_common(1)[0][1] / n if kinds else 0.0),
        pairs / max(len(words) - 1, 1), len(set(lines)) / len(lines), len(set(sentences)) / max(len(sentences), 1), len(lines) / n,
        len(_SYMBOL.findall(text)) / chars, len(_MARK.findall(text)) / chars, len(_STOP.findall(text)) / n, len(_DIGIT.findall(text)) / chars,
        len(_UPPER.findall(text)) / chars, sum(1 for _ in _RUN.finditer(text)) / n, sum(1 for w in words if len(w) <= 3) / n,
        sum(1 for w in words if w[-1] in "$%&#*!") / n, text.count("|") / n, text.count("http") / n,
    ]


def page_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    out = np.zeros(LANGUAGES + SOURCES + 3)
    out[zlib.crc32((lang or "").encode()) % LANGUAGES] = 1
    out[LANGUAGES + zlib.crc32((source or "").encode()) % SOURCES] = 1
    size = np.log1p(max(n_chars or 0, 0))
    out[-3:] = size, size**2, n_chars is None
    return out


class Calibrated:
    """A view's classifier with Platt scaling."""

    def __init__(self, model):
        self.model, self.scale = model, Logistic(ridge=0.01)

    def fit(self, x: np.ndarray, y: np.ndarray, x_aside: np.ndarray, y_aside: np.ndarray) -> Calibrated:
        self.model.fit(x, y)
        self.scale.fit(self.model.raw(x_aside)[:, None], y_aside)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scale.raw(self.model.raw(x)[:, None]), -12, 12)


class Model:
    def __init__(self, text: Calibrated, page: Calibrated, both: Logistic):
        self.text, self.page, self.both = text, page, both

    def score(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        return self.both.score(np.column_stack([self.text.raw(text), self.page.raw(page)]))


def co_train(text: np.ndarray, page: np.ndarray, y: np.ndarray, aside: np.ndarray, pool_text: np.ndarray, pool_page: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Labelled rows of both views (those ``aside`` calibrate), and the same views of the unlabelled pool."""
    ours, theirs = (text, pool_text), (page, pool_page)
    extra = {0: (np.zeros(0, int), np.zeros(0)), 1: (np.zeros(0, int), np.zeros(0))}
    views: list[Calibrated] = []
    for number in range(rounds + 1):
        views = []
        for view, (known, pool) in enumerate((ours, theirs)):
            rows, given = extra[view]
            model = BoostedTrees() if view == 0 else Logistic(ridge=5.0)
            views.append(Calibrated(model).fit(np.vstack([known[~aside], pool[rows]]), np.r_[y[~aside], given], known[aside], y[aside]))
        if number == rounds or not len(pool_text):
            break
        for view, (_, pool) in enumerate((ours, theirs)):
            raw = views[view].raw(pool)
            sure = np.flatnonzero(np.abs(raw) >= np.log(CONFIDENT / (1 - CONFIDENT)))
            sure = np.setdiff1d(sure, extra[1 - view][0])
            sure = sure[np.argsort(-np.abs(raw[sure]), kind="stable")][:HANDED]
            rows, given = extra[1 - view]
            extra[1 - view] = (np.r_[rows, sure], np.r_[given, (raw[sure] > 0).astype(float)])
    both = Logistic(ridge=0.1).fit(np.column_stack([views[0].raw(text[aside]), views[1].raw(page[aside])]), y[aside])
    return Model(views[0], views[1], both)


COLUMNS = ("text", "lang", "source", "n_chars")


def _views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    at = {n: batch.column(batch.schema.get_field_index(n)) for n in COLUMNS}
    text = np.array([text_features(t.as_py() or "") for t in at["text"]])
    page = np.array([page_features(*row) for row in zip(*[at[n].to_pylist() for n in COLUMNS[1:]])])
    return text, page


def _chosen(docs: DataFrame, id_col: str) -> DataFrame:
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", sample: int = SAMPLE, pool: int = POOL,
        rounds: int = ROUNDS) -> Model | None:
    """Fit on bounded samples of ``docs``; None when no labelled row is among them."""
    spark = docs.sparkSession
    known = labelled_sample(labels, id_col, label, sample)
    rows = _chosen(docs, id_col)
    ids = rows.select("id").where("id is not null").join(labels.select(F.col(id_col).cast("long").alias("id")), "id", "left_anti")
    free = ids.distinct().orderBy(F.xxhash64("id"), "id").limit(pool).collect()
    wanted = spark.createDataFrame([(r["id"], -1) for r in free], "id long, y int").unionByName(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                text, page = _views(batch)
                lists = [pa.array(list(v), pa.list_(pa.float64())) for v in (text, page)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *lists], names=["id", "y", "text", "page"])

    # The samples' bounds bound the broadcast and, with one row an id, what comes back.
    chosen = rows.join(F.broadcast(wanted), "id").groupBy("id", "y").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("id", "row.*", "y")
    found = chosen.mapInArrow(run, "id long, y int, text array<double>, page array<double>").collect()
    found.sort(key=lambda r: r["id"])
    view = lambda name, rows: np.array([r[name] for r in rows], float).reshape(len(rows), -1)
    labelled, unlabelled = [r for r in found if r["y"] >= 0], [r for r in found if r["y"] < 0]
    if not labelled:
        return None
    empty = np.zeros((0, len(labelled[0]["text"]))), np.zeros((0, len(labelled[0]["page"])))
    pools = (view("text", unlabelled), view("page", unlabelled)) if unlabelled else empty
    y = np.array([r["y"] for r in labelled], float)
    return co_train(view("text", labelled), view("page", labelled), y, set_aside([r["id"] for r in labelled], y), *pools, rounds)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id") -> DataFrame:
    """doc_id and quality (0 to 1, higher is better) of every input row.

    NULL and empty texts are scored as texts without words, NULL metadata as its own value.
    Rows that repeat an id are scored one by one. Without any labelled row the score is 1.0:
    nothing is known against a document. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                quality = model.score(*_views(batch)) if model else np.ones(len(batch))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(quality)], names=["doc_id", "quality"])

    return _chosen(docs, id_col).mapInArrow(run, "doc_id long, quality double")


def keep_good(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The input rows, all columns, whose quality is at least ``least``."""
    names = docs.columns
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield batch.filter(pa.array(model.score(*_views(batch)) >= least))

    return docs.select(names).mapInArrow(run, docs.schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", "quality", (F.col("quality") >= 0.5).cast("int").alias("predicted"))
