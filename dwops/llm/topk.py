"""Exact top-k inner products by pivot-table elimination.

Every vector's distances to a fixed set of pivots are computed once and stored with it. For
a query q and a row x, the largest |d(q, p) - d(x, p)| over the pivots p is a lower bound of
d(q, x), and since 2 <q, x> = |q|^2 + |x|^2 - d(q, x)^2, it gives an upper bound of the score.
Rows are evaluated in the order of that bound until the next bound lies below the k-th
score found: the rest cannot enter, not even by a tie.

Rows and queries are dealt into blocks of bounded size, and each pair of a row block and a
query block is one group: it yields k rows a query, which are then merged.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dwops.session import stored

PIVOTS = 32
BLOCK_VALUES = 1_000_000   # numbers in a block of rows
QUERY_BLOCK = 1_024
CHUNK = 128
SCALE = 1024


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, pivots: int = PIVOTS) -> DataFrame:
    """The usable rows with whole-number components and pivot distances, stored.

    Components become floor(scale * x) in double precision. Rows whose vector is NULL or empty
    or holds a NULL or non-finite component are left out. Pivots are the rows of smallest hash.
    """
    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    usable = chosen.where(F.col("x").isNotNull() & (F.size("x") > 0)).where(F.forall("x", finite))
    whole = usable.withColumn("x", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long")))
    picked = [np.array(r["x"], float) for r in whole.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(pivots).collect()]

    def run(batches):
        for batch in batches:
            rows = [np.array(v.as_py(), float) for v in batch.column(1)]
            away = [[float(np.sqrt(((p - r) ** 2).sum())) for p in picked if len(p) == len(r)] for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away, pa.list_(pa.float64()))], names=["vec_id", "x", "away"])

    table = whole.mapInArrow(run, "vec_id long, x array<long>, away array<double>")
    return stored(table.withColumn("row", F.monotonically_increasing_id()))


def entering(scores: np.ndarray, k: int, least: int | None) -> np.ndarray:
    """Which scores can be among the k best, ties included; ``least`` is the k-th score found before, if there are k."""
    keep = np.ones(len(scores), bool) if least is None else scores >= least
    if keep.sum() > k:
        keep &= scores >= np.partition(scores[keep], -k)[-k]
    return keep


def _best(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int, int]] = []
        by_size: dict[int, list[int]] = {}
        vectors = rows.column("x").to_pylist()
        for i, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(i)
        ids, numbers = np.asarray(rows.column("vec_id").to_pylist(), object), np.asarray(rows.column("row"))
        away_all = rows.column("away").to_pylist()
        parts, as_float = {}, {}
        for size, at in by_size.items():
            x = np.array([vectors[i] for i in at], np.int64)
            parts[size] = (np.array(at), x, (x.astype(float) ** 2).sum(axis=1), np.array([away_all[i] for i in at], float).reshape(len(at), -1))
        for qid, q, q_away, q_row in zip(*[queries.column(c).to_pylist() for c in ("vec_id", "x", "away", "row")]):
            if len(q) not in parts:
                continue
            at, x, norms, away = parts[len(q)]
            q = np.array(q, np.int64)
            # Every partial sum is at most |x| |q|; below 2^53 doubles hold it exactly.
            if np.sqrt(norms.max()) * np.sqrt((q.astype(float) ** 2).sum()) < 2.0**52:
                if as_float.get(len(q)) is None:
                    as_float[len(q)] = x.astype(float)
                x, q = as_float[len(q)], q.astype(float)
            lower = np.abs(away - np.array(q_away)).max(axis=1) if away.shape[1] else np.zeros(len(at))
            upper = ((q.astype(float) ** 2).sum() + norms - lower**2) / 2
            upper += 1e-9 * (np.abs(upper) + norms) + 1  # rounding of the bound
            order = np.argsort(-upper, kind="stable")
            best: list[tuple[int, int, int]] = []
            begin, width = 0, CHUNK
            while begin < len(order):
                if len(best) == k and upper[order[begin]] < -best[-1][0]:
                    break
                some = order[begin : begin + width]
                # Chunks double, so at most about as many rows again are evaluated as the bound asks for.
                begin, width = begin + width, 2 * width
                some = some[numbers[at[some]] != q_row]
                scores = (x[some] @ q).astype(np.int64)
                # Python sees only the rows that may enter.
                may = np.flatnonzero(entering(scores, k, -best[-1][0] if len(best) == k else None))
                found = [(-int(scores[j]), ids[at[some[j]]], int(numbers[at[some[j]]])) for j in may]
                best = sorted(best + found, key=lambda r: (r[0], r[1] is None, r[1] or 0, r[2]))[:k]
            out += [(qid, q_row, r, -s, i) for s, i, r in best]
        names = ["query_id", "query_row", "row", "score", "vec_id"]
        return pa.table([pa.array([r[j] for r in out], pa.int64()) for j in range(5)], names=names)

    return run


def search(table: DataFrame, queries: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row that ``queries`` marks.

    Equal scores go to the smaller vec_id (NULL last). A query's own row is no candidate, but
    another row of the same id or vector is. Only vectors of the query's length are compared;
    a query with fewer than k candidates returns them all, without any it returns no row.
    """
    width = table.select(F.max(F.size("x")).alias("w"), F.count(F.lit(1)).alias("n"), F.count_if(queries).alias("q")).first()
    rows_per_block = max(1, BLOCK_VALUES // max(width["w"] or 1, 1))
    row_blocks, query_blocks = max(1, ceil(width["n"] / rows_per_block)), max(1, ceil(width["q"] / QUERY_BLOCK))
    own = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = table.withColumn("g", own(row_blocks)).withColumn("h", every(query_blocks))
    asked = table.where(queries).withColumn("h", own(query_blocks)).withColumn("g", every(row_blocks))
    schema = "query_id long, query_row long, row long, score long, vec_id long"
    best = rows.groupBy("g", "h").cogroup(asked.groupBy("g", "h")).applyInArrow(_best(k), schema)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (SELECT row_number() OVER () r, vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x AS double))) x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.r qr, q.vec_id query_id, c.vec_id, c.r, cast(list_dot_product(q.x, c.x) AS bigint) score
      FROM v q JOIN v c ON q.r <> c.r AND q.vec_id % 100 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id, r) rn FROM p)
SELECT query_id, cast(rn AS integer) AS rank, vec_id, score FROM n WHERE rn <= 10
"""
