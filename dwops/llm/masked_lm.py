"""Masked pseudo-likelihood: a bidirectional window network scores every word from both sides.

Words are coded by their rank in the whole corpus; rarer ones share hashed codes. A code is
two digits (class, member), and the network gives P(class | context) and P(member | class,
context), so a word costs two short softmaxes. The context is the ``SIDE`` words on either
side; places beyond the text are a boundary code. Embeddings, one hidden layer and both
softmaxes are trained in numpy by parallel averaging: in each round every task starts from
the shared weights, learns from the masked places (one in ``MASK``) of all its documents, and
the masks of ``MASK`` rounds hold every place once. Spark averages the tasks' weights by their numbers of places. The model's size is fixed.
The texts are read twice before the rounds, once to count words and once to code them; the rounds read codes.

A document's score is the sum of log P(word | both sides) over all its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from dwops.llm.text import mix, slices, words
from dwops.session import stored

DIGITS = 64
SLOT = np.uint64(48)            # without so many last bits a hash is a slot
RARE = 64                       # codes shared by words that are not among the most frequent
CODES = DIGITS * DIGITS
KNOWN = CODES - RARE
BOUNDARY = CODES
SIDE, WIDTH, HIDDEN = 3, 16, 32
MASK, BATCH, RATE = 8, 128, 0.05
ROUNDS = MASK                   # so that every word is predicted once
AT_ONCE = 1 << 10              # places scored together, few enough to stay in the processor's cache
PLAIN = 80                      # within this, exp needs no shift
OFFSETS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])

SHAPES = {
    "embed": (CODES + 1, WIDTH), "mix": (2 * SIDE * WIDTH, HIDDEN), "mix0": (HIDDEN,), "head": (HIDDEN, DIGITS), "head0": (DIGITS,),
    "member": (HIDDEN, DIGITS), "member0": (DIGITS,), "of_class": (DIGITS, DIGITS),
}
SIZE = sum(int(np.prod(s)) for s in SHAPES.values())
LANES = 16                      # weights go to their sum in rows of so many; divides SIZE


def unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def start_weights(counts: np.ndarray) -> np.ndarray:
    """Small random weights; the biases state the codes' frequencies."""
    random = np.random.default_rng(11)
    flat = random.normal(0, 0.1, SIZE).astype(np.float32)
    w = unpack(flat)
    grid = counts[:CODES].reshape(DIGITS, DIGITS) + 0.5
    w["mix0"][:] = w["member0"][:] = 0
    w["head0"][:] = np.log(grid.sum(axis=1) / grid.sum())
    w["of_class"][:] = np.log(grid / grid.sum(axis=1, keepdims=True))
    return flat


class Vocabulary:
    """Word hashes -> codes."""

    def __init__(self, hashes: np.ndarray, ranks: np.ndarray):
        """Hashes of the most frequent words in ascending order, and each one's rank by frequency."""
        self.hashes, self.ranks, self.slots = hashes, ranks, None

    @classmethod
    def ranked(cls, hashes: np.ndarray) -> Vocabulary:
        """From the hashes of the most frequent words, most frequent first."""
        order = np.argsort(hashes)
        return cls(hashes[order], order.astype(np.int32))

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        rare = (KNOWN + (hashes & np.uint64(RARE - 1))).astype(np.int32)
        if not len(self.hashes):
            return rare
        # Most words have the slot of their first bits for themselves; those of a shared one are searched for.
        if self.slots is None:
            slot = (self.hashes >> SLOT).astype(np.int64)
            n, self.slots = np.bincount(slot, minlength=1 << 16), np.zeros(1 << 16, np.int64)
            self.slots[slot] = np.arange(len(slot))
            self.slots[n > 1] = -1
        at = self.slots.take((hashes >> SLOT).astype(np.int64))
        shared = np.flatnonzero(at < 0)
        at[shared] = np.minimum(np.searchsorted(self.hashes, hashes[shared]), len(self.hashes) - 1)
        return np.where(self.hashes.take(at) == hashes, self.ranks.take(at), rare)


def padded(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All documents' codes in one array with SIDE boundaries around each, and the words' places in it."""
    place = np.arange(len(codes)) + SIDE * (1 + np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)))
    out = np.full(len(codes) + SIDE * len(offsets), BOUNDARY, np.int32)
    out[place] = codes
    return out, place


def _exp(z: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """z becomes exp(z - c) in place, with one c a row of DIGITS; the rows' sums, and c. ``plain``: z is known to be within PLAIN."""
    rows = z.reshape(-1, DIGITS)
    c = np.zeros(len(rows), np.float32)
    if len(rows) and not plain and not (-PLAIN < z.min() and z.max() < PLAIN):
        c = rows.max(axis=1)
        rows -= c[:, None]
    np.exp(z, out=z)
    return rows @ np.ones(DIGITS, np.float32), c


def _heads(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Both softmaxes' weights and biases side by side."""
    return np.hstack([w["head"], w["member"]]), np.concatenate([w["head0"], w["member0"]])


def log_probabilities(w: dict[str, np.ndarray], line: np.ndarray, place: np.ndarray) -> np.ndarray:
    """log P(word | SIDE words before and after) at each place."""
    table = [w["embed"] @ w["mix"][j * WIDTH : (j + 1) * WIDTH] for j in range(2 * SIDE)]
    table[0] = table[0] + w["mix0"]
    both, _ = _heads(w)
    member0 = w["of_class"] + w["member0"]
    # No output of tanh is beyond 1, so this bounds what goes into exp.
    plain = bool(np.abs(both).sum(axis=0).max() + max(np.abs(w["head0"]).max(), np.abs(member0).max()) < PLAIN)
    out = np.empty(len(place), np.float64)
    for a in range(0, len(place), AT_ONCE):
        at = place[a : a + AT_ONCE]
        n = len(at)
        h = table[0].take(line[at + OFFSETS[0]], axis=0)
        for t, o in zip(table[1:], OFFSETS[1:]):
            h += t.take(line[at + o], axis=0)
        np.tanh(h, out=h)
        head, member = np.divmod(line[at], DIGITS)
        z = h @ both
        z[:, :DIGITS] += w["head0"]
        z[:, DIGITS:] += member0.take(head, axis=0)
        spots = np.arange(0, n * 2 * DIGITS, 2 * DIGITS)
        own = z.take(spots + head) + z.take(spots + DIGITS + member)
        sums, c = _exp(z, plain)
        out[a : a + AT_ONCE] = own - (np.log(sums) + c).reshape(n, 2).sum(axis=1)
    return out


def learn(flat: np.ndarray, line: np.ndarray, place: np.ndarray, rate: float = RATE) -> None:
    """Stochastic gradient steps over masked places, in place."""
    w = unpack(flat)
    embed, of_class = w["embed"].reshape(-1), w["of_class"].reshape(-1)  # views, for updates by single numbers
    both = np.vstack(_heads(w))  # the biases are the weights of a last input that is 1
    step = np.float32(rate * 32 / BATCH)
    wide, digits = np.arange(WIDTH), np.arange(DIGITS)
    contexts = line[place[:, None] + OFFSETS].astype(np.int64)
    heads, members = np.divmod(line[place].astype(np.int64), DIGITS)
    # Where each word's two digits lie among its step's outputs.
    inside = np.arange(len(place)) % BATCH * 2 * DIGITS
    targets = np.stack([inside + heads, inside + DIGITS + members], axis=1)
    # Room for one step, taken once.
    empty = lambda *shape: np.empty(shape, np.float32)
    room_x, room_z, room_d, room_own, room_g = empty(BATCH, 2 * SIDE, WIDTH), empty(BATCH, HIDDEN), empty(BATCH, 2 * DIGITS), empty(BATCH, DIGITS), empty(BATCH, HIDDEN)
    room_h = np.ones((BATCH, HIDDEN + 1), np.float32)
    of_both, of_mix = np.empty_like(both), np.empty_like(w["mix"])
    room_class, room_embed = np.empty((BATCH, DIGITS), np.int64), np.empty((BATCH, 2 * SIDE, WIDTH), np.int64)
    one = np.ones(BATCH, np.float32)
    for a in range(0, len(place), BATCH):
        context, head = contexts[a : a + BATCH], heads[a : a + BATCH]
        n = len(head)
        x, h1, d, own, dz, g = room_x[:n], room_h[:n], room_d[:n], room_own[:n], room_z[:n], room_g[:n]
        w["embed"].take(context, axis=0, out=x, mode="clip")
        np.dot(x.reshape(n, -1), w["mix"], out=dz)
        dz += w["mix0"]
        h = np.tanh(dz, out=h1[:, :HIDDEN])
        # Gradients of the two softmaxes' inputs, times the step.
        np.dot(h1, both, out=d)
        d[:, DIGITS:] += w["of_class"].take(head, axis=0, out=own, mode="clip")
        sums, _ = _exp(d)
        rows = d.reshape(-1, DIGITS)
        rows *= (step / sums)[:, None]
        d.reshape(-1)[targets[a : a + n]] -= step
        np.dot(d, both[:HIDDEN].T, out=dz)
        np.multiply(h, h, out=g)
        np.subtract(1, g, out=g)
        dz *= g
        both -= np.dot(h1.T, d, out=of_both)
        own[:] = d[:, DIGITS:]
        np.subtract.at(of_class, np.add((head * DIGITS)[:, None], digits, out=room_class[:n]).reshape(-1), own.reshape(-1))
        before = np.dot(x.reshape(n, -1).T, dz, out=of_mix)
        np.dot(dz, w["mix"].T, out=x.reshape(n, -1))
        np.subtract.at(embed, np.add((context * WIDTH)[:, :, None], wide, out=room_embed[:n]).reshape(-1), x.reshape(-1))
        w["mix"] -= before
        w["mix0"] -= one[:n] @ dz
    w["head"][:], w["member"][:] = both[:HIDDEN, :DIGITS], both[:HIDDEN, DIGITS:]
    w["head0"][:], w["member0"][:] = both[HIDDEN, :DIGITS], both[HIDDEN, DIGITS:]


def count_words(texts: DataFrame) -> DataFrame:
    """hash, n over the whole corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, documents in slices(batch.column(0)):
                hashes, n = np.unique(words(data, documents).hashes, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    return texts.mapInArrow(run, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


class Model:
    def __init__(self, vocabulary: Vocabulary, flat: np.ndarray):
        self.vocabulary, self.flat = vocabulary, flat

    def document_scores(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        line, place = padded(codes, offsets)
        sums = np.concatenate([[0.0], np.cumsum(log_probabilities(unpack(self.flat), line, place))])
        return sums[offsets[1:]] - sums[offsets[:-1]]


def train(docs: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> Model:
    """Vocabulary and weights from all documents."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = stored(count_words(texts))
    # As many rows as there are codes, whatever the corpus.
    top = counts.orderBy(F.desc("n"), "hash").limit(KNOWN).collect()
    vocabulary = Vocabulary.ranked(np.array([r["hash"] for r in top], np.int64).view(np.uint64))
    share = np.ones(CODES)
    share[: len(top)] = [r["n"] for r in top]
    # A shared code has the count of all its words: those of its bucket without the known ones.
    share[KNOWN:] = 0
    bucket = F.col("hash").bitwiseAND(RARE - 1)
    for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).collect():
        share[KNOWN + r["bucket"]] = r["n"]
    for r in top:
        share[KNOWN + (r["hash"] & (RARE - 1))] -= r["n"]
    flat = start_weights(share)
    if rounds and top:
        texts = coded(texts, vocabulary)
        for k in range(rounds):
            flat = _round(texts, flat, k)
    return Model(vocabulary, flat)


def masked(offsets: np.ndarray, k: int) -> np.ndarray:
    """Which words round k masks: about one in MASK of each document's, by a hash, so that no rhythm of a text hides words."""
    inside = np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
    return mix(inside.astype(np.uint64)) % np.uint64(MASK) == k % MASK


def coded(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The words' codes of all texts, a row for each slice of a task, so that the rounds need not read texts.

    part names the task, codes has 16 bits a word and ends 64 bits a document: where its words end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            for _, data, documents in slices(batch.column(0)):
                w = words(data, documents)
                codes = vocabulary.codes(w.hashes).astype(np.int16).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([codes], pa.binary()), pa.array([w.offsets[1:].astype(np.int64).tobytes()], pa.binary())],
                                                 names=["part", "codes", "ends"])

    return stored(texts.mapInArrow(run, "part int, codes binary, ends binary"))


def _round(texts: DataFrame, flat: np.ndarray, k: int) -> np.ndarray:
    """The weights after round k over coded texts. Every part starts from the shared ones, also where a task reads several.

    Arrays that travelled have a type of their own, for which numpy has no fast paths: a step took 4 times as long. ``astype`` gives the usual one.
    """

    lanes = [f"v{j}" for j in range(LANES)]

    def result(own: np.ndarray, seen: int) -> pa.RecordBatch:
        values = (own.astype(np.float64) * seen).reshape(LANES, -1)
        n = values.shape[1]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *map(pa.array, values), pa.array(np.full(n, float(seen)))], names=["i", *lanes, "seen"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, last = flat.astype(np.float32), 0, None
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                if part != last and seen:
                    yield result(own, seen)
                    own, seen = flat.astype(np.float32), 0
                last = part
                codes, ends = (np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in ((1, np.int16), (2, np.int64)))
                offsets = np.r_[0, ends]
                line, place = padded(codes, offsets)
                chosen = place[masked(offsets, k)]
                learn(own, line, chosen)
                seen += len(chosen)
        if seen:
            yield result(own, seen)

    kinds = ", ".join(f"{v} double" for v in lanes)
    summed = texts.mapInArrow(run, f"i int, {kinds}, seen double").groupBy("i").agg(*(F.sum(v).alias(v) for v in lanes), F.sum("seen").alias("seen"))
    out = flat.copy()
    rows = summed.select("i", *((F.col(v) / F.col("seen")).alias(v) for v in lanes)).collect()  # SIZE numbers
    if rows:
        out.reshape(LANES, -1)[:, [r["i"] for r in rows]] = np.array([r[1:] for r in rows]).T
    return out


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over words) and mean_log_likelihood of every row.

    NULL, empty and blank texts have no words, the sum 0.0 and a NULL mean. Rows that repeat
    an id are scored one by one; equal texts score equally. Other columns are ignored.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # Plain arrays of fixed size; the class itself travels with the function.
    vocabulary = model.vocabulary
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary.hashes, vocabulary.ranks, model.flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks, flat = shared.value
        known = Vocabulary(hashes, ranks)
        own = Model(known, flat.astype(np.float32))
        for batch in batches:
            for first, data, documents in slices(batch.column(1)):
                w = words(data, documents)
                sums = own.document_scores(known.codes(w.hashes), w.offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sums)), pa.array(np.diff(w.offsets).astype(np.int64)), pa.array(sums)],
                                                 names=["doc_id", "n_tokens", "log_likelihood"])

    scored = chosen.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double")
    return scored.withColumn("mean_log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))


def report(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs))
