"""Alignment of two tokenizers against a byte-by-byte count."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from dwops.llm import alignment
from dwops.llm.queries import QUERIES
from dwops.sources.tables import load
from tests.llm.test_llm import SF, documents, prose


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_values():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def spans(pieces):
    out, at = [], 0
    for piece in pieces:
        out.append((at, at + len(piece)))
        at += len(piece)
    return out


def brute(tokenizers, rows):
    """Every pair of tokens compared through the bytes they cover."""
    a, b = tokenizers
    value, linked, held = byte_values(), [], Counter()
    for doc_id, text in rows:
        raw = (" " + text).encode() if text else b""
        a_ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b.encode(text) if text else []
        a_tokens = [bytes(value[c] for c in a.id_to_token(i)) for i in a_ids]
        b_tokens = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if not raw or b"".join(a_tokens) != raw or b"".join(b_tokens) != raw:
            linked.append((doc_id, 0, 0, None, []))
            continue
        a_spans, b_spans = spans(a_tokens), spans(b_tokens)
        a_of = [k for k, (s, e) in enumerate(a_spans) for _ in range(s, e)]
        b_of = [k for k, (s, e) in enumerate(b_spans) for _ in range(s, e)]
        links = [(a_ids[x], b_ids[y]) for x, y in dict.fromkeys(zip(a_of, b_of))]
        held.update(set(links))
        ends = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
        groups, start = [], 0
        for end in ends:
            groups.append(",".join(str(i) for i, (s, e) in zip(a_ids, a_spans) if start <= s and e <= end) + "|"
                          + ",".join(str(i) for i, (s, e) in zip(b_ids, b_spans) if start <= s and e <= end))
            start = end
        linked.append((doc_id, len(a_ids), len(b_ids), groups, links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return sorted((str(d), n_a, n_b, len(groups or []), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links),
                   hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for d, n_a, n_b, groups, links in linked)


def got(frame):
    return sorted((str(r["doc_id"]), *r[1:]) for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())


ROWS = [
    (1, "Hello  world, it's a test of unbelievable tokenization."), (2, None), (3, ""), (4, " "), (5, "\n\n a\tb \r\n"), (6, "naïve Straße — 中文字 🙂 ünïcode"),
    (7, "a▁b"), (8, "<|endoftext|> <s> </s> <unk> <0x41>"), (9, "x" * 300), (None, "no id here"), (None, None), (1, "Hello  world, it's a test of unbelievable tokenization."),
    (10, "12345 3.14159 100,000"), (11, "nul\0byte"), (12, "    indented    text    "),
]


@pytest.mark.parametrize("block_bytes", [1, 300, alignment.BLOCK_BYTES])
def test_every_link_against_brute_force(spark, tokenizers, block_bytes):
    rows = ROWS + [(100 + i, prose(20)) for i in range(30)]
    assert got(alignment.report(documents(spark, rows).repartition(3), block_bytes=block_bytes)) == brute(tokenizers, rows)


def test_kept_windows_may_be_dropped(spark, tokenizers, monkeypatch):
    monkeypatch.setattr(alignment, "WINDOWS_KEPT", 3)
    assert got(alignment.report(documents(spark, ROWS), block_bytes=50)) == brute(tokenizers, ROWS)


def test_long_text_and_text_without_spaces(spark, tokenizers):
    rows = [(1, prose(250_000)), (2, "unbroken" * 5000)]
    assert len(rows[0][1]) > 1 << 20
    found = {r["doc_id"]: r for r in alignment.report(documents(spark, rows)).collect()}
    for doc_id, text in rows:
        a, b = tokenizers
        assert (found[doc_id]["n_a"], found[doc_id]["n_b"]) == (len(a.encode(" " + text, add_special_tokens=False).ids), len(b.encode(text)))
        assert found[doc_id]["n_links"] == found[doc_id]["n_a"] + found[doc_id]["n_b"] - found[doc_id]["n_groups"]


def test_empty_table_and_id_map(spark, tokenizers):
    assert alignment.report(documents(spark, [])).count() == 0
    pairs = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in alignment.id_map(documents(spark, [(1, "the the"), (2, "the"), (3, "cat")])).collect()}
    a, b = tokenizers
    the = (a.encode(" the").ids[0], b.encode("the")[0])
    assert pairs[the] == (2, True)


def test_query_against_brute_force(spark, tokenizers):
    rows = [(r["doc_id"], r["text"]) for r in load(spark, SF, "documents").collect()]
    assert got(QUERIES["op11_token_alignment"](spark, SF)) == brute(tokenizers, rows)


def test_ids_of_kept_words_are_the_tokenizers(tokenizers):
    import random

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        sides = alignment.Sides(a.read(), b.read())
    assert sides.by_word
    draw, seen = random.Random(11), 0
    for _ in range(6000):
        text = "".join(draw.choice(["the", "in", "a", "b", " ", " ", " ", "  ", "\n", "\t", "é", "中", "▁", "1", "23", ".", ",", "\0", "<s>", "'s", "\u00a0", "\u3000"]) for _ in range(draw.randint(1, 14)))
        seen += not alignment._APART.search(text)
        got = [list(memoryview(side).cast("I")) for side in sides.ids(text)]
        assert got == [tokenizers[0].encode(" " + text, add_special_tokens=False).ids, tokenizers[1].encode(text)], repr(text)
    assert seen > 1000
