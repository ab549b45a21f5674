"""Minimal functional dependencies and what they say about normal forms, level by level.

A set of columns determines another column when adding it splits no group: both sets have the
same number of distinct values. Sets are looked at by size, each level counted in one grouping.
Following the usual lattice rules only sets without redundancy are extended: none of their
columns is determined by the others, and none of their subsets is a key. NULL is a value like any other.

What is shuffled is a 128-bit hash per distinct value of a set, whatever the columns hold. The
driver sees one number per set of column names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from dwops.session import stored


def distinct_counts(hashed: DataFrame, sets: list[frozenset[int]]) -> dict[frozenset[int], int]:
    """Number of distinct values of each set of columns; ``hashed`` has two hashes a column, ``h0, g0, h1, ...``."""
    if not sets:
        return {}
    cells = [F.struct(F.lit(i).alias("s"), *[F.xxhash64(F.lit(i), *[F.col(f"{side}{c}") for c in sorted(columns)]).alias(side) for side in "hg"])
             for i, columns in enumerate(sets)]
    sizes = hashed.select(F.inline(F.array(*cells))).distinct().groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    found = {r["s"]: r["n"] for r in sizes.collect()}
    return {columns: found.get(i, 0) for i, columns in enumerate(sets)}


def lattice(df: DataFrame, columns: list[str], most: int = 3) -> tuple[list[tuple[frozenset[int], int]], list[frozenset[int]]]:
    """Minimal dependencies (set -> column) with at most ``most`` columns on the left, and the minimal keys among them."""
    text = lambda c, seed: F.xxhash64(F.lit(seed), F.col(c).isNull(), F.col(c).cast("string"))
    hashed = stored(df.select(*[text(c, 17).alias(f"h{i}") for i, c in enumerate(columns)], *[text(c, 91).alias(f"g{i}") for i, c in enumerate(columns)]))
    total = hashed.count()
    if not total:
        return [], []
    counts = {frozenset(): 1} | distinct_counts(hashed, [frozenset([i]) for i in range(len(columns))])
    found: list[tuple[frozenset[int], int]] = [(frozenset(), i) for i in range(len(columns)) if counts[frozenset([i])] == 1]
    keys: list[frozenset[int]] = []
    free = [frozenset()]
    for size in range(1, most + 1):
        # Sets of this size whose subsets are all free and which have no column that the others determine.
        smaller = set(free)
        free = []
        for chosen in map(frozenset, combinations(range(len(columns)), size)):
            below = [chosen - {c} for c in chosen]
            if all(b in smaller and b not in keys for b in below) and all(counts[chosen] > counts[b] for b in below):
                free.append(chosen)
        keys += [s for s in free if counts[s] == total]
        asked = [(s, a) for s in free for a in range(len(columns)) if a not in s and not any(left <= s and right == a for left, right in found)]
        new = sorted({s | {a} for s, a in asked} - counts.keys(), key=sorted)
        counts |= distinct_counts(hashed, new)
        found += [(s, a) for s, a in asked if counts[s | {a}] == counts[s]]
    return found, keys


def find_dependencies(df: DataFrame, columns: list[str], most: int = 3) -> DataFrame:
    """Minimal dependencies: determinant (columns joined by commas), dependent, kind.

    ``key``: the determinant is a key. ``partial``: it is part of a key, which breaks the second
    normal form. ``transitive``: it is neither, so a key determines it and it the dependent, which
    breaks the third. ``prime``: as the two before, but the dependent is itself part of a key, which
    the third normal form allows. ``constant``: the column has one value. Keys and determinants
    are looked for with up to ``most`` columns. An empty table has no dependencies.
    """
    found, keys = lattice(df, columns, most)
    prime = set().union(*keys)

    def kind(left: frozenset[int], right: int) -> str:
        if not left:
            return "constant"
        if left in keys:
            return "key"
        if right in prime:
            return "prime"
        return "partial" if any(left < k for k in keys) else "transitive"

    rows = [(",".join(sorted(columns[c] for c in left)), columns[right], kind(left, right)) for left, right in found]
    return df.sparkSession.createDataFrame(rows, "determinant string, dependent string, kind string")


def transitive_chains(df: DataFrame, columns: list[str], most: int = 3) -> DataFrame:
    """key, via, dependent: chains key -> via -> dependent where via is neither a key nor part of one."""
    found, keys = lattice(df, columns, most)
    prime, name = set().union(*keys), lambda s: ",".join(sorted(columns[c] for c in s))
    rows = [(name(k), name(left), columns[right]) for left, right in found for k in keys
            if left and left not in keys and right not in prime and not any(left < other for other in keys) and right not in k]
    return df.sparkSession.createDataFrame(rows, "key string, via string, dependent string")
