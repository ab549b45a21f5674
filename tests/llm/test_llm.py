"""The training-data operators on small rows: brute force, ties, NULLs, empty tables, clashing columns."""

import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwops.llm import cotraining, decontaminate, licenses, masked_lm, near_dedup, packing, substring_dedup, token_counts, tokens, topk, toxicity
from dwops.llm.models import Isotonic
from dwops.llm.queries import QUERIES, SQL
from tests.check import compare, duck

SF = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RANDOM = np.random.default_rng(5)
WORDS = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(RANDOM.choice(WORDS, n))


def documents(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names the operators use inside."""
    full = [(i, t, "en", "s", len(t or ""), "x", 1, 2) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, name string, n int, key int")


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def changed(text, n):
    w = text.split()
    for i in RANDOM.choice(len(w), n, replace=False):
        w[i] = "changed%d" % RANDOM.integers(1 << 40)
    return " ".join(w)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), SQL[name]) == []


def brute_components(rows):
    sets, least = {i: shingle_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            least[y] = x
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def test_near_duplicates(spark):
    base = prose(200)
    rows = [(0, base), (1, base.upper()), (2, None), (3, ""), (4, " \t\n"), (5, "a b"), (6, "A  B"), (7, "a b c")]
    rows += [(10 + i, changed(base, int(n))) for i, n in enumerate(RANDOM.integers(0, 9, 60))]  # near copies around the bound
    chain = base
    for i in range(12):
        chain = changed(chain, 4)
        rows.append((100 + i, chain))
    rows += [(200 + i, prose(120)) for i in range(20)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(documents(spark, rows)).collect()}
    assert got == brute_components(rows)
    kept = {r["doc_id"] for r in near_dedup.keep_first(documents(spark, rows)).collect()}
    assert kept == {i for i, v in got.items() if v[2]}


def test_near_duplicates_null_and_repeated_ids(spark):
    text = prose(60)
    rows = [(None, text), (7, text), (7, text), (7, prose(60)), (None, None)]
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in near_dedup.near_duplicates(documents(spark, rows)).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7), (7, 7)]
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    assert near_dedup.keep_first(documents(spark, rows)).count() == 5


def test_keep_first_judges_rows_by_their_text(spark):
    a, b, c = prose(60), prose(60), prose(60)
    rows = [(3, a), (5, a), (5, b), (7, changed(c, 1)), (3, c)]
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.keep_first(documents(spark, rows)).collect()) == sorted([(3, a), (5, b), (3, c)])


def test_posterior_bound_keeps_likely_pairs():
    (n1, m1), *_, (n, m) = near_dedup.needed_matches(0.75)
    assert n1 == 32 and n == 128 and m < 0.65 * n and m1 < 0.5 * n1


def test_decontaminate(spark):
    item, short = prose(25), "exactly three words"
    docs = [(1, f"{prose(30)} {item.upper().replace(' ', ', ')} {prose(5)}"), (2, prose(50)), (3, None), (4, ""), (5, "Exactly  three-words!"),
            (6, " ".join(item.split()[:9])), (7, f"{item} {item}"), (7, "é " + short), (None, short)]
    items = spark.createDataFrame([(1, item), (2, short), (3, None), (4, "..."), (None, item), (12, item)], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.report(documents(spark, docs), items).collect()))
    assert got == [(0, 3, 3, 1), (1, 60, 25, 2), (2, 50, 0, 0), (3, 0, 0, 0), (4, 0, 0, 0), (5, 3, 3, 1), (6, 9, 0, 0), (7, 4, 3, 1), (7, 50, 50, 2)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(documents(spark, docs), items).collect()) == [2, 3, 4, 6]
    none = items.limit(0)
    assert decontaminate.report(documents(spark, docs), none).where("contaminated").count() == 0
    assert decontaminate.report(documents(spark, []), items).count() == 0
    spans = decontaminate.find_passages(documents(spark, [(5, "Exactly  three-words!")]), items).first()
    assert "Exactly  three-words!".encode()[spans["from_byte"][0] : spans["to_byte"][0]] == b"Exactly  three-words"


def test_words_are_counted_without_items(spark):
    none = spark.createDataFrame([(1, None)], "item_id long, text string")
    for items in (none, none.limit(0)):
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"]) for r in decontaminate.report(documents(spark, [(1, "a b, c"), (2, None)]), items).collect()) == [(1, 3, 0), (2, 0, 0)]


def test_one_row_of_a_repeated_id_is_fitted(spark, monkeypatch):
    rows = [(i, prose(20)) for i in range(20)] + [(0, prose(20))] * 30
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    seen = []
    for module in (cotraining, toxicity):
        monkeypatch.setattr(module, "set_aside", lambda ids, y, f=module.set_aside: seen.append(sorted(ids)) or f(ids, y))
    cotraining.fit(documents(spark, rows), labels)
    toxicity.fit(documents(spark, rows), labels)
    assert seen == [list(range(20))] * 2


def test_item_blocks_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, prose(30)) for i in range(12)], "item_id long, text string")
    docs = documents(spark, [(i, f"{prose(20)} {r['text']} {prose(3)}") for i, r in enumerate(items.collect())])
    one = sorted(map(tuple, decontaminate.report(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert len(decontaminate.item_blocks(spark, items, "item_id", "text")) > 3
    assert sorted(map(tuple, decontaminate.report(docs, items).collect())) == one


def test_encoder_equals_tokenizer():
    encode = tokens.Encoder(tokens.default_path())
    letters = "ab Z'sdtllvere  \n\t\r09éßñ—’“.…!?*_-ÿŁ½²ª \u0085\x1c日本١<|endoftext|>"
    for text in ["".join(RANDOM.choice(list(letters), RANDOM.integers(0, 40))) for _ in range(500)] + ["", "<|endoftext|>"]:
        assert encode(text) == encode.whole(text)


def best_fit_decreasing(counts, capacity):
    room = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else capacity) - n)
    return len(room)


def test_plan_places_every_piece_once():
    for _ in range(100):
        counts = {int(n): int(RANDOM.integers(0, 30)) for n in RANDOM.integers(1, 31, 12)}
        used, bins = {}, {}
        for length, first, last, at, each, offset in packing.plan(counts, 30):
            assert used.get(length, 0) == first
            used[length] = last
            for r in range(last - first):
                bins.setdefault(at + r // each, []).append((offset + r % each * length, length))
        assert used == {n: c for n, c in counts.items() if c}
        for spans in bins.values():
            end = 0
            for offset, length in sorted(spans):
                assert offset == end
                end += length
            assert end <= 30
        assert len(bins) <= best_fit_decreasing(counts, 30) + 1


def test_packing_round_trip(spark):
    rows = [(1, prose(900)), (2, None), (3, ""), (4, "x"), (4, "x"), (None, prose(40)), (5, prose(3000))]
    got = packing.pack(documents(spark, rows), capacity=256).collect()
    encode = tokens.Encoder(tokens.default_path())
    want = []
    for i, t in rows:
        ids = encode(t or "") + np.array([2], tokens.ID).tobytes()
        ends = sorted(range(len(ids), 0, -1024))  # full pieces of 256 ids from the end; only the first may be shorter
        want += [(i or 0, zlib.crc32(ids[s:e]), s // 4, (e - s) // 4) for s, e in zip([0, *ends], ends)]
    want.sort()
    assert sorted((r["doc_id"] or 0, r["ids_crc32"], r["start"], r["length"]) for r in got) == want
    by_bin = {}
    for r in got:
        by_bin.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_bin.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 256
    assert packing.pack(documents(spark, [])).count() == 0


def test_long_documents_are_cut_as_stated(spark):
    word = " the"  # one id
    sizes = {1: 2499, 2: 1023, 3: 1024, 4: 2047, 5: 0}
    got = packing.pack(documents(spark, [(i, word * n) for i, n in sizes.items()])).orderBy("doc_id", "piece").collect()
    assert [(r["doc_id"], r["piece"], r["start"], r["length"]) for r in got] == [
        (1, 0, 0, 452), (1, 1, 452, 1024), (1, 2, 1476, 1024), (2, 0, 0, 1024), (3, 0, 0, 1), (3, 1, 1, 1024), (4, 0, 0, 1024), (4, 1, 1024, 1024), (5, 0, 0, 1)]


def test_topk_edge_rows(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, []), (7, [1.0, 2.0, 3.0]),
            (100, [0.5, 0.5]), (200, [-0.25, 0.0]), (None, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(topk.index(vectors), F.col("vec_id") % 100 == 0, 3).orderBy("query_id", "rank").collect()]
    assert got[:3] == [(0, 1, 1, 786432), (0, 2, 2, 786432), (0, 3, 2, 786432)]
    assert got[3:6] == [(100, 1, 0, 786432), (100, 2, 1, 524288), (100, 3, 2, 524288)]
    assert topk.search(topk.index(vectors.limit(0)), F.col("vec_id") % 100 == 0).count() == 0


def test_topk_hands_on_only_rows_that_may_enter():
    scores = np.array([5, 9, 9, 1, 7, 9, 3])
    assert topk.entering(scores, 2, None).nonzero()[0].tolist() == [1, 2, 5]  # ties stay
    assert topk.entering(scores, 4, None).nonzero()[0].tolist() == [1, 2, 4, 5]
    assert topk.entering(scores, 9, 7).nonzero()[0].tolist() == [1, 2, 4, 5]
    assert not topk.entering(scores, 2, 10).any() and not len(topk.entering(scores[:0], 2, None))
    assert topk.entering(np.arange(50_000), 10, None).sum() == 10


def test_topk_is_exact_for_large_components(spark):
    # Products beyond 2^53, where doubles would round the last digits away.
    base = 2.0**20
    vectors = spark.createDataFrame([(0, [base + 1, base])] + [(i, [base + i, base]) for i in range(1, 40)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.search(topk.index(vectors), F.col("vec_id") == 0, 3).orderBy("rank").collect()]
    whole = lambda x: int(x) * 1024
    want = [(0, n, i, whole(base + 1) * whole(base + i) + whole(base) ** 2) for n, i in enumerate((39, 38, 37), 1)]
    assert got == want and want[0][3] > 2**53


def test_topk_blocks(spark, monkeypatch):
    x = RANDOM.normal(size=(300, 8))
    x[100:200] = x[100]  # one very common vector
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK_VALUES", 400)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 10)
    got = {}
    for r in topk.search(topk.index(vectors), F.col("vec_id") % 7 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = np.floor(1024 * x).astype(np.int64)
    for q in range(0, 300, 7):
        scores = whole @ whole[q]
        best = sorted((-scores[i], i) for i in range(300) if i != q)[:10]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_separator_scan(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "RUN", 3)
    rows = [(i, t) for i, t in enumerate(["", "a b", None, "word " * 500, "x"] * 6)] + [(None, "y z"), (0, "again")]
    blocks, order = token_counts.write_flat(documents(spark, rows).coalesce(2), block_ids=37)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in order.join(token_counts.count_tokens(blocks), ["file", "document"]).collect())
    encode = tokens.Encoder(tokens.default_path())
    assert got == sorted((i if i is not None else -1, len(encode(t or "")) // 4) for i, t in rows)
    assert token_counts.report(documents(spark, [])).count() == 0


def test_flat_files(spark, tmp_path):
    ids = np.array([5, 6, 50256, 50256, 7, 8, 9], "<u2")
    ids.tofile(tmp_path / "a.bin")
    got = token_counts.count_tokens(token_counts.read_flat(spark, str(tmp_path), block_ids=2)).orderBy("document").collect()
    assert [(r["document"], r["start"], r["n_tokens"], r["ended"]) for r in got] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, False)]


def test_compact_windows_cover_every_passage():
    for _ in range(20):
        values = RANDOM.integers(0, 50, 120).astype(np.uint64)
        found = substring_dedup.compact_windows(values, 10)
        for i in range(120):
            for j in range(i + 9, 120):
                holders = [(left, c, r) for left, c, r in found if left <= i <= c <= j <= r]
                assert len(holders) == 1 and values[holders[0][1]] == values[i : j + 1].min()


def test_repeated_passages(spark):
    passage, other = prose(60), prose(52)
    near = changed(prose(300), 0)
    rows = [(1, f"{prose(30)} {passage} {prose(40)}"), (2, f"{passage.upper()}\n{prose(80)}"), (3, f"{prose(90)} {other}"), (4, f"{other} {prose(10)}"), (5, prose(200)),
            (6, None), (7, ""), (8, "short text"), (9, near), (10, changed(near, 3)), (None, passage), (11, f"{prose(20)} {' '.join(passage.split()[:40])} {prose(20)}")]
    got = {(r["doc_id"], r["of_doc_id"]): r for r in substring_dedup.repeated_passages(documents(spark, rows)).collect()}
    assert set(got) == {(2, 1), (4, 3), (10, 9)}
    assert (got[2, 1]["start_word"], got[2, 1]["end_word"], got[2, 1]["of_start_word"]) == (0, 60, 30) and got[2, 1]["similarity"] == 1.0
    left = {r["doc_id"]: r for r in substring_dedup.cut_repeats(documents(spark, rows), size_col="n_chars").collect()}
    assert left[2]["text"].split() == rows[1][1].split()[60:] and left[2]["n_chars"] == len(left[2]["text"])
    assert left[1]["text"] == rows[0][1] and left[11]["text"] == rows[-1][1] and left[6]["text"] is None
    assert substring_dedup.repeated_passages(documents(spark, [])).count() == 0


def similarity_of(a, b):
    return len(a & b) / len(a | b)


def test_edited_passages_are_verified():
    """Brute force: a passage that reaches 0.75 is found whole, whatever words were changed, added or left out."""
    cases = [(n, [at]) for n in range(51, 101) for at in range(n)] + [(int(n), RANDOM.choice(int(n), k, replace=False)) for k in range(2, 6) for n in RANDOM.integers(50, 101, 100)]
    cases += [(200, [20, 60, 100, 140, 180])]
    fresh = iter(range(10**9, 2 * 10**9))
    for kind in range(3):
        for n, places in cases:
            own = [next(fresh) for _ in range(n)]
            other = [x for k, w in enumerate(own) for x in ([w] if k not in places else [next(fresh)] if kind == 0 else [] if kind == 1 else [w, next(fresh)])]
            sets = [[hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)] for w in (own, other)]
            if len(other) < 50 or similarity_of(*map(set, sets)) < 0.75:
                continue
            around = [[next(fresh) for _ in range(60)] for _ in range(4)]
            mine, theirs = (np.array([hash(tuple(w[k : k + 5])) for k in range(len(w) - 4)]) for w in (around[0] + own + around[1], around[2] + other + around[3]))
            common = np.flatnonzero(np.isin(mine, theirs))
            found = substring_dedup.passages(mine, theirs)
            assert any(a <= common[0] and common[-1] <= b for a, b, *_ in found), (kind, n, places)
            for a, b, a2, b2, both, share in found:
                assert b - a >= 45 and b2 - a2 >= 45 and share == similarity_of({*mine[a : b + 1]}, {*theirs[a2 : b2 + 1]}) >= 0.75


def test_cells_are_the_compact_windows():
    offsets = np.array([0, 30, 150, 150, 400])
    values = RANDOM.integers(0, 1 << 60, 400).astype(np.uint64)
    values[200:230] = values[300:330]
    values[360:380] = values[360]
    want = {}
    for a, b in zip(offsets, offsets[1:]):
        for salt in substring_dedup._SALTS:
            # Equal shingles have equal hashes, of which the leftmost counts.
            for left, c, r in substring_dedup.compact_windows(substring_dedup.mix(values[a:b] * salt) & ~substring_dedup._LOW) if b - a >= 46 else []:
                begin, end = max(left, c - 45), min(c, r - 45)
                if begin <= end:
                    least, most = want.get(a + c, (1 << 30, -1))
                    want[a + c] = min(least, a + begin), max(most, a + end)
    got = {c: (begin, end) for c, begin, end in zip(*(x.tolist() for x in substring_dedup.cells(offsets, values)))}
    assert got == want


def test_edited_passages_are_reported(spark):
    """Passages of 50 words at a similarity near 0.75: few have no common signature."""
    rows, near = [], 0
    for i in range(400):
        passage = prose(50)
        w = passage.split()
        w[20 + i % 11] = "changed%d" % i
        rows += [(2 * i, f"{prose(30)} {passage} {prose(30)}"), (2 * i + 1, f"{prose(30)} {' '.join(w)} {prose(30)}")]
        near += similarity_of(shingle_set(passage), shingle_set(" ".join(w))) >= 0.75
    got = {(r["doc_id"], r["of_doc_id"]) for r in substring_dedup.repeated_passages(documents(spark, rows)).collect()}
    assert near == 400 and len(got & {(2 * i + 1, 2 * i) for i in range(400)}) >= 396


def test_common_line_hides_no_passage(spark, monkeypatch):
    """The line's cells agree with every document's; the one pair that goes on alike is found, in blocks too."""
    line = prose(30)
    passage = f"{line} {prose(24)}"
    w = passage.split()
    w[12] = "other"
    rows = [(i, f"{prose(60)} {line} {prose(60)}") for i in range(60)] + [(70, f"{prose(60)} {passage} {prose(60)}"), (71, f"{prose(60)} {' '.join(w)} {prose(60)}")]
    # Each has something else before and after the line than the first holder.
    rows += [(-1 - i, f"{prose(60)} {' '.join(w[k : k + 30])} {prose(60)}") for i, k in enumerate(range(0, 24, 3))]
    for block in (4096, 16):
        monkeypatch.setattr(substring_dedup, "BLOCK", block)
        got = {(r["doc_id"], r["of_doc_id"]) for r in substring_dedup.repeated_passages(documents(spark, rows)).collect()}
        assert got == {(71, 70)}


def test_common_line_is_decided_without_pairs(spark, monkeypatch):
    """Of many documents around one line those with nothing else in common leave before pairs are looked at."""
    line, more = prose(30), prose(14)
    rows = [(i, f"{prose(50)} {line} {prose(50)}") for i in range(150)]
    rows += [(200, f"{prose(60)} {line} {more} {prose(60)}"), (201, f"{prose(60)} {line} {more.replace(' ', ' x ', 1)} {prose(60)}")]
    blocks, seen = substring_dedup._blocks, []

    def counted(around):
        seen.append(around.agg({"n": "max"}).first()[0])
        return blocks(around)

    monkeypatch.setattr(substring_dedup, "BLOCK", 16)
    monkeypatch.setattr(substring_dedup, "_blocks", counted)
    substring_dedup.repeated_passages(documents(spark, rows)).count()
    assert len(seen) == 1 and seen[0] <= 16  # classes of a key; the line's keys have over 100 before


def test_pairs_put_aside_hold_no_passage():
    """What is put aside before verification would not have been verified: edits, runs and few words."""
    put_aside = found = 0
    for k in range(600):
        a = RANDOM.integers(0, 1 << 30 if k % 3 else 40, 93)
        if k % 3 == 1:
            a[20 : 20 + RANDOM.integers(5, 70)] = 7
        b = np.where(RANDOM.random(93) < RANDOM.uniform(0, 0.4), RANDOM.integers(1 << 30, 1 << 31, 93), a)
        a, b = a[: RANDOM.integers(46, 94)].astype(np.int32), np.roll(b, RANDOM.integers(0, 30))[: RANDOM.integers(46, 94)].astype(np.int32)
        at, near = int(RANDOM.integers(0, 46)), np.r_[a, b]
        row = np.repeat([0, 1], [len(a), len(b)])
        entry = np.unique(row.astype(np.uint64) << np.uint64(32) | near.view(np.uint32))
        known, code = np.unique(entry & np.uint64(0xFFFFFFFF), return_inverse=True)
        alike = substring_dedup._Alike(np.array([0, len(a), len(near)]), near, known, np.zeros(2, np.uint64), (entry >> np.uint64(32)).astype(np.int64), code)
        first, second = np.array([0]), np.array([1])
        may = alike.may(first, second, np.array([at]))[0] and alike.may(second, first)[0]
        real = any(x <= at <= y for x, y, *_ in substring_dedup.passages(a, b))
        assert may or not real
        put_aside, found = put_aside + (not may), found + real
    assert put_aside > 100 and found > 50


def test_rhythms_and_long_texts_are_verified():
    """A few words repeated many times are one stretch; a text of many edits is judged without trying all pairs of runs."""
    rhythm = np.tile(np.arange(3), 60)
    mine, theirs = np.r_[np.arange(100, 160), rhythm, np.arange(200, 260)], np.r_[np.arange(300, 390), rhythm, np.arange(400, 430)]
    (a, b, a2, b2, both, share), = substring_dedup.passages(mine, theirs)
    assert (a, b, both, share) == (60, 239, 3, 1.0) and a2 >= 90 and b2 < 270
    long = np.arange(40_000)
    edited = np.where(long % 20 < 5, long + 10**6, long)  # 15 found for 5 lost: below the similarity
    edited[[7, 40_000 - 1]] = edited[8]                   # a repeated shingle
    assert substring_dedup.passages(long, edited) == []


def test_needed_shingles_of_a_rhythm():
    near = np.r_[np.arange(30), np.tile([100, 101], 30)]
    for at in (10, 50, 80):
        starts = [k for k in range(len(near) - 45) if k <= at < k + 46]
        assert substring_dedup._needed(near, at) == min(40, -(-3 * min(len({*near[k : k + 46]}) for k in starts) // 4))


def test_passage_of_many_documents(spark):
    passage = prose(70)
    rows = [(i, f"{prose(20)} {passage} {prose(20)}") for i in range(40)]
    got = substring_dedup.repeated_passages(documents(spark, rows))
    assert {r["doc_id"] for r in got.where("of_doc_id = 0").collect()} == set(range(1, 40))


def test_toxicity_held_out(spark):
    insults = ["idiot", "moron"]
    rows = [(i, prose(40) + (f" you {insults[i % 2]} {prose(5)}" if i % 4 == 0 else "")) for i in range(400)] + [(900, None), (901, ""), (None, "hello")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.report(documents(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert all(r["predicted"] == int(r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 4 == 0) for r in got)
    assert toxicity.report(documents(spark, rows), labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.report(documents(spark, []), labels).count() == 0


def test_isotonic_pools_violators():
    steps = Isotonic().fit(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert steps(np.array([0.1, 0.25, 0.4])).tolist() == [0.0, 0.5, 1.0]


def test_co_training(spark):
    rows = [(i, "$$$ " + "%%% ".join(prose(30).split()) if i % 5 == 0 else prose(60) + ".") for i in range(300)] + [(900, None), (None, "")]
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 150)], "doc_id long, quality int")
    got = {r["doc_id"]: r["predicted"] for r in cotraining.report(documents(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(got[i] == int(i % 5 != 0) for i in range(300))
    model = cotraining.fit(documents(spark, rows), labels)
    kept = cotraining.keep_good(documents(spark, rows), model)
    assert {r["doc_id"] for r in kept.where("doc_id < 300").collect()} == {i for i in range(300) if i % 5}
    assert cotraining.report(documents(spark, rows), labels.limit(0)).where("predicted = 1").count() == len(rows)
    assert cotraining.report(documents(spark, []), labels).count() == 0


def test_masked_lm(spark):
    rows = [(i, " ".join(["a b c d e f"] * int(RANDOM.integers(5, 20)))) for i in range(200)] + [(900, None), (901, " "), (902, "f a d c b e " * 10), (903, "a b c d e f " * 10), (904, "zz yy")]
    docs = documents(spark, rows).coalesce(2)
    model = masked_lm.train(docs, rounds=8)
    got = {r["doc_id"]: r for r in masked_lm.score(docs, model).collect()}
    assert got[900]["log_likelihood"] == got[901]["log_likelihood"] == 0 and got[900]["mean_log_likelihood"] is None
    assert got[903]["mean_log_likelihood"] > got[902]["mean_log_likelihood"] + 0.5 and got[903]["n_tokens"] == 60
    weights = masked_lm.unpack(model.flat)
    # One place by hand, and all codes' probabilities there.
    line = np.array([4096, 4096, 4096, 3, 9, 70, 4096, 4096, 4096], np.int32)
    probabilities = []
    for code in range(masked_lm.CODES):
        line[4] = code
        probabilities.append(masked_lm.log_probabilities(weights, line, np.array([4]))[0])
    assert abs(np.exp(probabilities).sum() - 1) < 1e-3
    x = np.concatenate([weights["embed"][line[4 + o]] for o in masked_lm.OFFSETS])
    h = np.tanh(x @ weights["mix"] + weights["mix0"])
    soft = lambda z: np.exp(z) / np.exp(z).sum()
    by_hand = soft(h @ weights["head"] + weights["head0"])[1] * soft(h @ weights["member"] + weights["member0"] + weights["of_class"][1])[6]
    assert abs(np.log(by_hand) - probabilities[70]) < 1e-3
    assert masked_lm.report(documents(spark, [])).count() == 0


def test_masked_lm_rounds_read_codes_and_steps_are_the_gradient(spark, monkeypatch):
    """Texts are split into words twice, not again in every round; a step agrees with the formulas written out."""
    docs = documents(spark, [(i, prose(40)) for i in range(20)]).coalesce(2)
    read, coded = [], masked_lm.coded
    monkeypatch.setattr(masked_lm, "coded", lambda *given: read.append(coded(*given)) or read[-1])
    rounds = masked_lm._round
    monkeypatch.setattr(masked_lm, "_round", lambda texts, flat, k: rounds(texts, flat, k) if texts is read[0] else pytest.fail("a round reads texts"))
    masked_lm.train(docs)
    assert sum(len(r["codes"]) for r in read[0].collect()) == 2 * 20 * 40
    flat = masked_lm.start_weights(np.ones(masked_lm.CODES))
    flat[:] = RANDOM.normal(0, 0.3, masked_lm.SIZE)
    line, place = masked_lm.padded(RANDOM.integers(0, 300, 200).astype(np.int32), np.array([0, 50, 50, 200]))
    w = {k: v.astype(np.float64) for k, v in masked_lm.unpack(flat.copy()).items()}
    mine = flat.copy()
    masked_lm.learn(mine, line, place)
    for a in range(0, 200, masked_lm.BATCH):
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        for at in place[a : a + masked_lm.BATCH]:
            context = line[at + masked_lm.OFFSETS]
            x = w["embed"][context].ravel()
            h = np.tanh(x @ w["mix"] + w["mix0"])
            top, low = divmod(line[at], masked_lm.DIGITS)
            d1, d2 = (np.exp(z) / np.exp(z).sum() for z in (h @ w["head"] + w["head0"], h @ w["member"] + w["member0"] + w["of_class"][top]))
            d1[top] -= 1
            d2[low] -= 1
            dz = (w["head"] @ d1 + w["member"] @ d2) * (1 - h * h)
            for name, g in (("head", np.outer(h, d1)), ("head0", d1), ("member", np.outer(h, d2)), ("member0", d2), ("mix", np.outer(x, dz)), ("mix0", dz)):
                grad[name] += g
            grad["of_class"][top] += d2
            np.add.at(grad["embed"], context, (w["mix"] @ dz).reshape(-1, masked_lm.WIDTH))
        for name, g in grad.items():
            w[name] -= masked_lm.RATE * 32 / masked_lm.BATCH * g
    for name, value in masked_lm.unpack(mine).items():
        assert np.abs(value - w[name]).max() < 1e-4, name
    # Scores that exp cannot take as they are.
    w = masked_lm.unpack(mine)
    w["head0"] += np.linspace(-500, 500, masked_lm.DIGITS).astype(np.float32)
    assert np.isfinite(masked_lm.log_probabilities(w, line, place)).all()
    masked_lm.learn(mine, line, place)
    assert np.isfinite(mine).all()


def test_masked_lm_counts_and_masks_every_word(spark):
    n = 3 * masked_lm.KNOWN
    docs = documents(spark, [(1, " ".join(f"v{i}" for i in range(n)))])
    head = masked_lm.unpack(masked_lm.train(docs, rounds=0).flat)["head0"]
    # The last class holds the shared codes, with two thirds of all words; each code counts half a word more.
    assert abs(np.exp(head)[-1] / np.exp(head).sum() - (n * 2 / 3 + 32) / (n + masked_lm.CODES / 2)) < 0.001
    offsets = np.array([0, 7, 7, 500, 3000])
    assert masked_lm.ROUNDS >= masked_lm.MASK
    assert (sum(masked_lm.masked(offsets, k).astype(int) for k in range(masked_lm.MASK)) == 1).all()


def test_licenses(spark):
    rows = [("a/LICENSE", 1, "Released under the MIT License."), ("a/x.py", 2, "code"), ("a/b/y.py", 3, None), ("a/b/c/z.py", 4, "Licensed under the Apache License, Version 2.0.\nmore"),
            ("d/x.py", 5, "released under the mit license"), ("d/e/COPYING.txt", 6, "This work is licensed under the GNU General Public License, version 3."), ("d/e/q", 7, ""),
            ("top.txt", 8, "words"), (None, 9, "words"), ("a/b/c/LICENSED.txt", None, "under the license of"), ("a/x.py", 2, "code")]
    docs = spark.createDataFrame([(p, i, t, "x") for p, i, t in rows], "path string, doc_id long, text string, license string")
    got = sorted(((r["doc_id"] or 0, r["license"], r["basis"], r["from_dir"]) for r in licenses.scan(docs, F.col("path")).collect()), key=str)
    assert got == sorted([(1, "MIT", "own", None), (2, "MIT", "inherited", "a"), (2, "MIT", "inherited", "a"), (3, "MIT", "inherited", "a"), (4, "Apache-2.0", "own", None), (5, "MIT", "own", None),
                          (6, "GPL-3.0", "own", None), (7, "GPL-3.0", "inherited", "d/e"), (8, None, "none", None), (9, None, "none", None), (0, "MIT", "inherited", "a")], key=str)
    assert licenses.scan(docs.limit(0), F.col("path")).count() == 0


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns, name
        assert {r["doc_id"] for r in after.select("doc_id").collect()} <= {r["doc_id"] for r in kept.select("doc_id").collect()}
        kept = after
    # With 87 labels the classifier errs on a few rows; what it rejects must be gone.
    rejected = cotraining.report(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0")
    left = {r["doc_id"] for r in kept.select("doc_id").collect()}
    gone = {r["doc_id"] for r in rejected.collect()}
    assert gone and not left & gone
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == left
