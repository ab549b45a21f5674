"""MinHash near-duplicate documents with sequential Bayesian verification.

1. One pass names every text's word sequence (128 bits) and makes its MinHash signature.
   Exact copies share the name and are one node from here on.
2. Signatures are cut into bands; nodes that share a band are candidates. Instead of all
   pairs of a bucket, each node meets its bucket's smallest node (a star).
3. Candidate signatures are compared batch by batch. With a uniform prior, m agreements of
   n leave the posterior P(similarity >= threshold) = P(Binomial(n + 1, threshold) <= m); a
   pair whose posterior falls below ``miss`` after some batch is pruned.
4. Survivors are verified on the full shingle sets of their texts.
5. Stars leave open only pairs of nodes that lie in one bucket but, after linking, in
   different components. Per bucket the nodes outside its largest component meet all
   others in blocks, again pruned and verified, so that no link between components is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from dwops.llm.components import components
from dwops.llm.text import SHINGLE, names, shingles, slices, words
from dwops.session import stored

BANDS, ROWS = 32, 4   # a pair at 0.75 shares no band with probability 5e-6
BATCH = 32            # signature places compared between two looks at the posterior
MISS = 1e-6
PERCENT = 75
BLOCK = 1 << 16       # shingles hashed at once

_FUNCTIONS = np.random.default_rng(7).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
FACTOR, SHIFT = _FUNCTIONS[0] | np.uint64(1), _FUNCTIONS[1]


def signatures(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Signed 32-bit MinHash signature per document; documents without shingles get zeros."""
    counts = np.diff(offsets)
    out = np.full((len(counts), len(FACTOR)), np.iinfo(np.uint64).max, np.uint64)
    first = 0
    full = np.flatnonzero(counts)
    while first < len(full):
        last = max(first + 1, int(np.searchsorted(offsets[full], offsets[full[first]] + BLOCK)))
        rows = full[first:last]
        begin, end = offsets[rows[0]], offsets[rows[-1] + 1]
        for at in range(begin, end, BLOCK) if len(rows) == 1 else [begin]:
            part = values[at : min(end, at + BLOCK) if len(rows) == 1 else end]
            cuts = [0] if len(rows) == 1 else offsets[rows] - begin
            for k in range(len(FACTOR)):
                least = np.minimum.reduceat(part * FACTOR[k] + SHIFT[k], cuts)
                out[rows, k] = np.minimum(out[rows, k], least)
        first = last
    out[counts == 0] = 0
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def needed_matches(threshold: float, miss: float = MISS, places: int = BANDS * ROWS, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, least m) after each batch: with fewer agreements the posterior is below ``miss``."""
    out = []
    for n in range(batch, places + 1, batch):
        below, m = 0.0, -1
        while m < n and below < miss:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def may_link(a: Column, b: Column, threshold: float) -> Column:
    """The sequential test on two signatures; later batches are read only if earlier ones pass."""
    agree = lambda x, y, n: F.aggregate(F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    test = None
    for n, m in needed_matches(threshold):
        step = agree(a, b, n) >= m
        test = step if test is None else test & step
    return test


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.int32())
    for batch in batches:
        ids, text = batch.column(0), batch.column(1)
        for first, data, documents in slices(text):
            w = words(data, documents)
            offsets, values = shingles(w)
            n = [len(np.unique(values[offsets[i] : offsets[i + 1]])) for i in range(len(documents) - 1)]
            signed = signatures(offsets, values)
            flat = pa.array(signed.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, signed.shape[1], dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(first, len(n)), pa.array(names(w), pa.binary()), pa.array(n, pa.int64()), lists.cast(kind)], names=["doc_id", "name", "n", "sig"])


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            hub_names, hub_texts, node_names = batch.column(0), batch.column(1), batch.column(2)
            for first, data, documents in slices(batch.column(3)):
                w = words(data, documents)
                offsets, values = shingles(w)
                own = names(w)
                for i in range(len(documents) - 1):
                    row = first + i
                    hub = hub_names[row].as_py()
                    if last[0] != hub:
                        _, d, o = next(slices(hub_texts.slice(row, 1)))
                        hw = words(d, o)
                        # A row of the same id but another text is not the node asked for.
                        last = (hub, np.unique(shingles(hw)[1])) if names(hw)[0] == hub else (None, None)
                    if last[1] is None or own[i] != node_names[row].as_py():
                        continue
                    mine = np.unique(values[offsets[i] : offsets[i + 1]])
                    common = len(np.intersect1d(mine, last[1], assume_unique=True))
                    if 100 * common >= percent * (len(mine) + len(last[1]) - common):
                        keep.append(row)
            picked = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([node_names.take(picked), hub_names.take(picked)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links among ``pairs(a, b)`` of node names, decided on whole texts."""
    where = nodes.select("name", F.col("doc_id").alias("place"))
    located = pairs.join(where.withColumnsRenamed({"name": "a", "place": "place_a"}), "a").join(where.withColumnsRenamed({"name": "b", "place": "place_b"}), "b")
    located = stored(located)
    mine = texts.select(F.col("doc_id").alias("id_a"), F.col("text").alias("text_a"))
    hubs = texts.select(F.col("doc_id").alias("id_b"), F.col("text").alias("text_b"))
    both = located.join(mine, F.col("place_a").eqNullSafe(F.col("id_a"))).select("a", "b", "place_b", "text_a")
    both = both.join(hubs, F.col("place_b").eqNullSafe(F.col("id_b"))).select("b", "text_b", "a", "text_a")
    return stored(both.mapInArrow(_verify(percent), "a binary, b binary").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id linked, itself included), kept.

    Words are runs of non-blank characters, A-Z lowered; a document's set holds its distinct
    shingles of five words, or its whole sequence if shorter. NULL, empty and blank texts have
    no shingles and stay alone. Rows of equal text are linked whatever their ids; rows that
    repeat an id are judged by their own texts. A NULL id is no component id: such a row gets
    the smallest non-NULL id linked to it, or NULL. An empty table gives no rows. Other
    columns are ignored.
    """
    return _judged(docs, id_col, text_col, percent).drop("name")


def _judged(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """``near_duplicates`` with the name of each row's text."""
    threshold = percent / 100
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = stored(texts.mapInArrow(_sign, "doc_id long, name binary, n long, sig array<int>"))
    nodes = stored(signed.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    bands = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)])
    rows = nodes.select("name", F.explode(bands).alias("bucket"))
    hubs = rows.groupBy("bucket").agg(F.min("name").alias("hub"), F.max("name").alias("last")).where("hub < last").drop("last")
    shared = stored(rows.join(hubs, "bucket"))

    sizes = nodes.select("name", "n", "sig")
    stars = shared.where("name > hub").select(F.col("name").alias("a"), F.col("hub").alias("b")).distinct()
    stars = _pruned(stars, sizes, threshold, percent)
    links = _verified(stars, nodes, texts, percent)
    found = stored(components(links))

    # Buckets whose nodes lie in several components.
    placed = shared.join(found.withColumnRenamed("node", "name"), "name", "left").select("bucket", "name", F.coalesce("component", "name").alias("component"))
    counts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
    main = counts.groupBy("bucket").agg(F.max(F.struct("m", "component")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_rows = stored(placed.join(main.select("bucket", F.col("most.component").alias("main")), "bucket").join(sizes, "name"))
    more = _crossing(open_rows, nodes, texts, percent)
    final = stored(components(links.unionByName(more)).withColumnRenamed("node", "name"))

    # Ids meet components over nodes, of which a group of exact copies is one.
    linked = nodes.select("name", "doc_id").join(final, "name", "left").withColumn("component", F.coalesce("component", "name"))
    smallest = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    ids = linked.select("name", "component").join(smallest, "component").select("name", "component_id")
    out = signed.select("doc_id", "name", "n").join(ids, "name", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "name", F.col("n").alias("n_shingles"), own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"))


U_ROWS, V_ROWS, BLOCK_SHINGLES = 256, 1024, 2_000_000


def _crossing(open_rows: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between nodes of one bucket that lie in different components.

    The nodes outside a bucket's largest component meet all its nodes. A bucket is cut into
    blocks of bounded size, and a block pair is decided inside a task: only links leave it.
    """
    places = open_rows.select("name").distinct().join(nodes.select("name", F.col("doc_id").alias("place")), "name")
    found = places.join(texts, F.col("place").eqNullSafe(F.col("doc_id"))).select("name", "text")
    outer = F.col("component") != F.col("main")
    blocks = lambda rows, words, most: F.ceil(F.greatest(rows / most, words / BLOCK_SHINGLES, F.lit(1.0))).cast("int")
    cuts = open_rows.groupBy("bucket").agg(
        blocks(F.sum(outer.cast("int")), F.sum(F.when(outer, F.col("n")).otherwise(0)), U_ROWS).alias("us"),
        blocks(F.count(F.lit(1)), F.sum("n"), V_ROWS).alias("vs"),
    )
    rows = open_rows.join(cuts, "bucket")
    place = lambda n: F.pmod(F.xxhash64("name"), n).cast("int")
    columns = ["bucket", "u", "v", "role", "name", "component", "main", "sig"]
    left = rows.where(outer).withColumns({"u": place(F.col("us")), "v": F.explode(F.sequence(F.lit(0), F.col("vs") - 1)), "role": F.lit(0)}).select(columns)
    right = rows.withColumns({"v": place(F.col("vs")), "u": F.explode(F.sequence(F.lit(0), F.col("us") - 1)), "role": F.lit(1)}).select(columns)
    both = left.unionByName(right).join(found, "name").repartition("bucket", "u", "v").sortWithinPartitions("bucket", "u", "v")
    return stored(both.select(*columns, "text").mapInArrow(_block_links(percent), "a binary, b binary").distinct())


def _block_links(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], axis=1)
            if not len(keys):
                continue
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                if key is not None and tuple(keys[a]) != key:
                    yield _links_within(held, percent)
                    held = []
                key = tuple(keys[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield _links_within(held, percent)

    return run


def _links_within(parts: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """Links of one block pair; a pair is looked at in the first band it shares."""
    table = pa.Table.from_batches(parts).combine_chunks()
    # Each row's whole set; a text of the same id that is not the node asked for is left out.
    rows, sets = [], []
    name = table.column("name").to_pylist()
    for first, data, documents in slices(table.column("text")):
        w = words(data, documents)
        offsets, values = shingles(w)
        for i, own in enumerate(names(w)):
            if own == name[first + i]:
                rows.append(first + i)
                sets.append(np.unique(values[offsets[i] : offsets[i + 1]]))
    role = np.asarray(table.column("role"))[rows] if rows else np.zeros(0, int)
    component, main = table.column("component").to_pylist(), table.column("main").to_pylist()
    code = {c: k for k, c in enumerate(dict.fromkeys(component + main))}
    order = {n: k for k, n in enumerate(sorted(set(name)))}
    comp = np.array([code[component[r]] for r in rows], int)
    middle = np.array([code[main[r]] for r in rows], int)
    rank = np.array([order[name[r]] for r in rows], int)
    size = np.array([len(s) for s in sets], int)
    sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(table), -1)[rows] if rows else None
    u, v = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    out: list[tuple[bytes, bytes]] = []
    if len(u) and len(v):
        owner = np.repeat(np.arange(len(u)), size[u])
        joined = np.concatenate([sets[i] for i in u])
        sort = np.argsort(joined, kind="stable")
        joined, owner = joined[sort], owner[sort]
        bucket_band = _common_band(sig[np.r_[u, v]])
        need = needed_matches(percent / 100)
        for j in v:
            open_ = (comp[u] != comp[j]) & ((comp[j] == middle[j]) | (rank[u] < rank[j]))
            open_ &= 100 * np.minimum(size[u], size[j]) >= percent * np.maximum(size[u], size[j])
            some = np.flatnonzero(open_)
            if not len(some):
                continue
            equal = sig[u[some]] == sig[j]
            shared = equal.reshape(len(some), BANDS, ROWS).all(axis=2)
            passed = shared.argmax(axis=1) >= bucket_band
            for n, m in need:
                passed &= equal[:, :n].sum(axis=1) >= m
            some = some[passed]
            if not len(some):
                continue
            lo, hi = np.searchsorted(joined, sets[j], "left"), np.searchsorted(joined, sets[j], "right")
            hits = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            common = np.bincount(owner[hits], minlength=len(u))[some]
            linked = some[100 * common >= percent * (size[u[some]] + size[j] - common)]
            out += [(name[rows[u[i]]], name[rows[j]]) for i in linked]
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _common_band(sig: np.ndarray) -> int:
    """The first band in which all rows of a bucket agree (they agree in the bucket's own)."""
    return int((sig == sig[0]).reshape(len(sig), BANDS, ROWS).all(axis=(0, 2)).argmax())


def _sizes_agree(a: str, b: str, percent: int) -> Column:
    """The smaller set holds at least the threshold's share of the larger one."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _pruned(pairs: DataFrame, sizes: DataFrame, threshold: float, percent: int) -> DataFrame:
    left = sizes.withColumnsRenamed({"name": "a", "n": "na", "sig": "sa"})
    right = sizes.withColumnsRenamed({"name": "b", "n": "nb", "sig": "sb"})
    joined = pairs.join(left, "a").join(right, "b")
    return joined.where(_sizes_agree("na", "nb", percent) & may_link(F.col("sa"), F.col("sb"), threshold)).select("a", "b")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The input rows that stay when of each group of near copies only the smallest id is kept.

    Rows that repeat an id are judged by their own texts. Rows with a NULL id stay. Of rows that
    repeat an id with texts in the same group all stay, since nothing tells them apart by id.
    All columns of the input are returned.
    """
    gone = _judged(docs, id_col, text_col, percent).where(~F.col("kept") & F.col("doc_id").isNotNull())
    gone = gone.select(F.col("doc_id").alias("__gone"), F.col("name").alias("__gone_name")).distinct()
    at = docs.columns.index(text_col)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: list[bytes] = []
            for _, data, documents in slices(batch.column(at).cast(pa.string())):
                own += names(words(data, documents))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary())], names=[*batch.schema.names, "__name"])

    rows = docs.mapInArrow(named, StructType([*docs.schema.fields, StructField("__name", BinaryType())]))
    same = (F.col(id_col).cast("long") == F.col("__gone")) & (F.col("__name") == F.col("__gone_name"))
    return rows.join(gone, same, "left_anti").select(docs.columns)
