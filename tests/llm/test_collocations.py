"""Collocations against counting every window of words."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from dwops.llm import collocations
from tests.llm.test_llm import ASCII, documents

RANDOM = np.random.default_rng(12)


def brute(rows, least, top):
    """rows of (lang, text) -> the listed phrases, straight from the definition."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {q[i : i + j] for q, b in kept.items() for j in range(2, len(q)) for i in range(len(q) - j + 1) if 100 * b >= 80 * kept[q[i : i + j]]}
        ranked = []
        for p, a in kept.items():
            if p not in covered:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]], score))
        ranked.sort()
        out += [(lang, i, r[2].decode(), r[3], r[4], r[5], totals[lang], r[6]) for i, r in enumerate(ranked[:top], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, 2, "y") for i, (lang, t) in enumerate(rows)],
                                 "doc_id long, text string, lang string, phrase string, n long, a long, shard string")


def got(found):
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def chatter(n, words=6):
    marks = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "! "]
    return "".join(str(RANDOM.choice(["Ab", "b", "c", "é", "D-d", "e"][:words])) + str(RANDOM.choice(marks)) for _ in range(n))


ROWS = ([("en", chatter(60)) for _ in range(40)] + [("fr", chatter(40, 4)) for _ in range(30)] + [(None, chatter(30, 3)) for _ in range(12)]
        + [("und", "a b"), ("en", None), ("en", ""), ("", "x y " * 20), ("de", ".,;:"), ("de", " \t "), ("en", "New York City " * 30), ("en", "new york. city\x0bnew\x0cyork\rcity")])


@pytest.mark.parametrize("shard_words", [1 << 20, 50, 7])
@pytest.mark.parametrize("least,top", [(3, 2000), (30, 9)])
def test_phrases_against_brute_force(spark, shard_words, least, top):
    found = collocations.collocations(frame(spark, ROWS).repartition(3), least=least, top=top, shard_words=shard_words)
    assert got(found) == brute(ROWS, least, top)


def test_ties_repeats_and_extensions(spark):
    rows = [("en", "b a. d c. a b")] * 30 + [("en", "p q r s. p q r t")] * 30
    found = collocations.collocations(frame(spark, rows))
    assert got(found) == brute(rows, 30, 2000)
    sides = {r["phrase"]: (r["left_extensions"], r["right_extensions"]) for r in found.collect()}
    assert sides["b a"] == (0, 0) and sides["p q r s"] == (0, 0)
    assert [r["phrase"] for r in found.where("score = 500000").orderBy("rank").collect()][:2] == ["a b", "b a"]


def test_long_text_goes_over_several_shards(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 1 << 16)
    rows = [("en", chatter(400_000)), ("en", "word" * 40_000 + " a b")]
    assert len(rows[0][1]) > 1 << 20
    assert got(collocations.collocations(frame(spark, rows), shard_words=50_000)) == brute(rows, 30, 2000)


def test_slices_end_between_words():
    data = b"aa bb\ncc" * 3 + b"x" * 50 + b" y"
    whole = b"".join(collocations._slices(data))
    assert whole == data and list(collocations._slices(b"")) == [b""]


def test_extension_step_against_the_definition():
    text = RANDOM.integers(0, 4, 300)
    text[-1] = 0
    order = sorted(range(300), key=lambda i: (*text[i : i + 4], *[0] * max(0, i + 4 - 300), i))
    bwt = np.array([text[i - 1] for i in order])
    counts = np.bincount(bwt, minlength=4)
    low = np.cumsum(counts)[:-1]
    high = low + counts[1:]
    for k in (2, 3, 4):
        low, size, counted, first, last = collocations.extend(bwt, low, high, np.zeros(0, np.int64))
        order_of = np.argsort(low)
        low, size = low[order_of], size[order_of]
        high = low + size
        expected = Counter(tuple(text[i : i + k]) for i in range(300 - k + 1) if all(text[i : i + k]))
        assert {tuple(text[order[a] : order[a] + k]): int(n) for a, n in zip(low, size)} == expected


def test_empty_and_rare_only(spark):
    assert collocations.collocations(frame(spark, [])).count() == 0
    assert collocations.collocations(frame(spark, [("en", "a b c"), ("fr", None)])).count() == 0
    assert collocations.collocations(documents(spark, [(1, "a b")])).count() == 0
    with pytest.raises(ValueError, match="too large"):
        collocations.collocations(frame(spark, []), shard_words=1 << 24)


def test_counts_beyond_64_bits(spark):
    row = spark.createDataFrame([(4 * 10**18, 4 * 10**18, 5 * 10**17)], "a long, f1 long, l1 long").select(collocations._cuts(("f1", "l1")).alias("c")).first()["c"]
    assert row["score"] == 2_000_000 * 4 * 10**18 // (4 * 10**18 + 5 * 10**17)
