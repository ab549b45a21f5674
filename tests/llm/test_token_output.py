"""Token id files: the code against exhaustive search, exact round trips, NULLs, ties, long texts."""

import random
import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dwops.llm import token_output
from dwops.llm.huffman import BLOCK, Code, code_lengths
from dwops.llm.queries import QUERIES
from dwops.llm.word_ids import WordEncoder
from dwops.sources.tables import load
from tests.llm.test_llm import SF, documents, prose

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(FILE)
    found.encode_special_tokens = True
    return found


def expected(tokenizer, rows):
    """Brute force: whole texts by the tokenizer, in order of id, number of ids and checksum."""
    out = []
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    starts = np.cumsum([0] + [r[1] for r in out])
    return [(d, int(s), n, c) for (d, n, c), s in zip(out, starts)]


def got(frame):
    rows = [tuple(r) for r in frame.select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    return sorted(rows, key=lambda r: r[1])


def test_lengths_are_the_best_under_the_limit():
    rng = np.random.default_rng(3)
    for _ in range(40):
        counts, limit = rng.integers(0, 40, rng.integers(2, 6)), int(rng.integers(3, 5))
        found = code_lengths(counts, limit)
        used = counts[counts > 0]
        if len(used) < 2:
            assert found.sum() == len(used)
            continue
        best = min(sum(b * c for b, c in zip(bits, used)) for bits in product(range(1, limit + 1), repeat=len(used)) if sum(2.0**-b for b in bits) <= 1)
        assert (found * counts).sum() == best and found.max() <= limit and (found[counts == 0] == 0).all()
    assert code_lengths(np.zeros(4)).sum() == 0
    with pytest.raises(ValueError, match="do not fit"):
        code_lengths(np.ones(9), 3)


@pytest.mark.parametrize("symbols,limit,n", [(1, 20, 5), (2, 20, 1000), (300, 9, BLOCK), (300, 9, BLOCK + 1), (49_408, 16, 70_000), (49_408, 20, 200_000)])
def test_code_round_trip_and_single_blocks(symbols, limit, n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.2, n) - 1, symbols - 1).astype(np.uint32)
    code = Code(code_lengths(np.bincount(ids, minlength=symbols), limit))
    data, offsets = code.encode(ids)
    data = np.frombuffer(data, np.uint8)
    assert (code.decode(data, offsets, n) == ids).all()
    for block in {0, len(offsets) // 2, len(offsets) - 1}:
        assert (code.decode(data, offsets, n, block, block + 1) == ids[block * BLOCK : (block + 1) * BLOCK]).all()
    missing = np.flatnonzero(code.lengths == 0)
    if len(missing):
        with pytest.raises(ValueError, match="no code"):
            code.encode(missing[:1])


def test_pieces_are_the_tokenizers(tokenizer):
    with open(FILE, "rb") as file:
        encode = WordEncoder(file.read())
    assert encode.by_piece
    draw = random.Random(4)
    for _ in range(4000):
        text = "".join(draw.choice("aAbZzéÉß09'.,;!  \n\t\r-_<|>s't'LLveÿÀ×÷\x85ıé中\0") for _ in range(draw.randint(0, 24)))
        assert encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert encode("a <|endoftext|> b") == np.array(tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids, "<u4").tobytes()


def test_rows_come_back_from_the_files(spark, tokenizer):
    rows = [(5, prose(700)), (3, None), (4, ""), (9, "It's 12.5% — naïve 中文 é"), (None, "no id"), (None, None), (-7, "below zero")]
    rows += [(8, "same")] * 4 + [(8, "another text")] + [(20 + i, prose(30)) for i in range(60)] + [(7, prose(180_000))]  # over 1 MiB
    random.Random(1).shuffle(rows)
    assert len(max((t or "" for _, t in rows), key=len)) > 1 << 19
    docs = documents(spark, rows).repartition(5)
    assert got(token_output.report(docs, file_ids=500)) == expected(tokenizer, rows)
    assert got(token_output.report(docs)) == expected(tokenizer, rows)
    folder = token_output.write_ids(docs, file_ids=500)
    assert spark.read.parquet(f"{folder}/files").count() > 3
    back = {(r["doc_id"], r["start"]): r["ids"] for r in token_output.read_ids(spark, folder).collect()}
    start = next(s for d, s, _, _ in expected(tokenizer, rows) if d == 5)
    assert bytes(back[(5, start)]) == np.array([*tokenizer.encode(dict(rows)[5], add_special_tokens=False).ids, 2], "<u4").tobytes()


def test_a_repeated_id_is_spread_over_tasks(spark, tokenizer):
    rows = [(1, f"copy {i % 7}") for i in range(4000)] + [(i, prose(5)) for i in range(2, 100)]
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")  # so few rows would be put together again
    folder = token_output.write_ids(documents(spark, rows).repartition(8))
    spark.conf.set(coalesce, "true")
    parts = spark.read.parquet(f"{folder}/files")
    assert parts.agg(F.max("docs")).first()[0] < 3000
    assert got(token_output.report(documents(spark, rows))) == expected(tokenizer, rows)


def test_files_of_lost_attempts_do_not_count(spark, tokenizer):
    rows = [(i, prose(20)) for i in range(30)]
    folder = token_output.write_ids(documents(spark, rows))
    name = spark.read.parquet(f"{folder}/files").first()["name"]
    path = folder.removeprefix("file://")
    with open(f"{path}/data/{name}", "rb") as file:
        content = file.read()
    with open(f"{path}/data/000000-000000-{'0' * 32}.ids", "wb") as file:
        file.write(content)
    found = token_output.read_ids(spark, folder)
    assert sorted(r["doc_id"] for r in found.select("doc_id").collect()) == list(range(30))
    damaged = bytearray(content)
    damaged[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        token_output.TokenFile(bytes(damaged))
    with pytest.raises(ValueError, match="not a token id file"):
        token_output.TokenFile(b"x" * 100)
    file = token_output.TokenFile(content)
    assert (np.concatenate([file.read_block(k) for k in range(len(file.offsets))]) == file.ids()).all()


def test_empty_table_and_single_row(spark, tokenizer):
    assert token_output.report(documents(spark, [])).count() == 0
    assert got(token_output.report(documents(spark, [(None, None)]))) == [(None, 0, 1, zlib.crc32(b"\2\0\0\0"))]


def test_query_against_the_tokenizer(spark, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in load(spark, SF, "documents").collect()]
    assert got(QUERIES["op13_token_output"](spark, SF)) == expected(tokenizer, rows)
