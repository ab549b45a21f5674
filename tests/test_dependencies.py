"""Minimal dependencies against checking every set of columns."""

import random
from itertools import combinations

import pytest

from dwops.operators import dependencies
from tests.test_rules import rows


def brute(data, names, most):
    """All minimal dependencies and keys straight from the definition."""
    value = lambda row, columns: tuple(row[c] for c in columns)
    holds = lambda left, a: len({value(r, left) for r in data}) == len({value(r, (*left, a)) for r in data})
    subsets = [s for n in range(most + 1) for s in combinations(range(len(names)), n)]
    found = []
    for a in range(len(names)):
        for left in subsets:
            if a not in left and holds(left, a) and not any(set(f) < set(left) for f, b in found if b == a):
                found.append((left, a))
    keys = [s for s in subsets if len({value(r, s) for r in data}) == len(data)]
    keys = [set(k) for k in keys if not any(set(other) < set(k) for other in keys)]
    prime = set().union(*keys)
    out = []
    for left, a in found:
        kind = "constant" if not left else "key" if set(left) in keys else "prime" if a in prime else "partial" if any(set(left) < k for k in keys) else "transitive"
        # A determinant that contains a key is not minimal; one that holds a smaller dependency neither.
        out.append((",".join(sorted(names[c] for c in left)), names[a], kind))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(6))
def test_random_tables(spark, seed):
    rnd = random.Random(seed)
    names = ["a", "b", "c", "d", "e"]
    data = []
    for i in range(rnd.choice([6, 15, 40])):
        a, b = rnd.randrange(5), rnd.choice([None, 0, 1])
        data.append((a, b, a % 2, rnd.randrange(3), i if seed % 2 else (a * 3 + (b or 0)) % 4))
    if seed == 4:
        data = [(*r[:3], 7, r[4]) for r in data]
    data = list(dict.fromkeys(data)) if seed % 3 else data
    df = spark.createDataFrame(data, "a int, b int, c int, d int, e int")
    assert rows(dependencies.find_dependencies(df, names, 3)) == brute(data, names, 3)


def test_key_to_a_to_b(spark):
    other = random.Random(5)
    data = [(i, f"n{i % 6}", f"r{i % 6 % 3}", other.randrange(3)) for i in range(60)]
    df = spark.createDataFrame(data, "id int, nation string, region string, other int")
    assert rows(dependencies.transitive_chains(df, ["id", "nation", "region", "other"])) == [("id", "nation", "region")]
    found = rows(dependencies.find_dependencies(df, ["id", "nation", "region", "other"]))
    assert ("nation", "region", "transitive") in found and ("id", "other", "key") in found


def test_a_part_of_a_composite_key(spark):
    data = [(o, line, f"customer {o % 3}", o * line % 5) for o in range(7) for line in range(3)]
    df = spark.createDataFrame(data, "o int, line int, customer string, qty int")
    assert ("o", "customer", "partial") in rows(dependencies.find_dependencies(df, ["o", "line", "customer", "qty"]))


def test_empty_one_row_and_null(spark):
    df = spark.createDataFrame([], "a int, b int")
    assert rows(dependencies.find_dependencies(df, ["a", "b"])) == []
    one = spark.createDataFrame([(1, None)], "a int, b int")
    assert rows(dependencies.find_dependencies(one, ["a", "b"])) == [("", "a", "constant"), ("", "b", "constant")]
    # NULL is a value of its own, apart from the text.
    texts = spark.createDataFrame([(None, 1), ("", 2), ("null", 3)], "a string, b int")
    assert rows(dependencies.find_dependencies(texts, ["a", "b"])) == [("a", "b", "key"), ("b", "a", "key")]
