"""Parts lists by layers against the walk over all paths."""

import random

import pytest

from dwops.operators import graph
from tests.test_rules import rows

SCHEMA = "part_id string, component_id string, quantity int"


def walk(edges, root):
    """Every path that enters no part twice."""
    below, out = {}, {}
    for part, component, n in edges:
        below.setdefault(part, []).append((component, n))

    def down(part, quantity, path):
        for component, n in below.get(part, []):
            if component not in path:
                total, depth = out.get(component, (0, 0))
                out[component] = (total + quantity * n, max(depth, len(path)))
                down(component, quantity * n, path | {component})

    down(root, 1, frozenset([root]))
    return sorted((c, q, d) for c, (q, d) in out.items())


def test_a_billion_paths(spark):
    """30 layers of two parts, each made of both parts below: 2^30 paths."""
    edges = [(f"{layer:02d}{a}", f"{layer + 1:02d}{b}", 1 if b == "x" else 2) for layer in range(30) for a in (["r"] if not layer else "xy") for b in "xy"]
    got = rows(graph.explode_bom(spark.createDataFrame(edges, SCHEMA), "00r"))
    assert got == [(f"{layer:02d}{b}", 3 ** (layer - 1) * (1 if b == "x" else 2), layer) for layer in range(1, 31) for b in "xy"]


@pytest.mark.parametrize("seed,cycles", [(1, False), (2, False), (3, True), (4, True), (5, True)])
def test_random_lists_against_all_paths(spark, seed, cycles):
    rnd = random.Random(seed)
    names = [f"p{i}" for i in range(9)]
    edges = []
    for _ in range(16):
        a, b = sorted(rnd.sample(range(9), 2), reverse=cycles and rnd.random() < 0.3)
        edges.append((names[a], names[b], rnd.randint(1, 4)))
    edges += edges[:2]  # repeated lines add up
    if cycles:
        edges.append(("p3", "p3", 2))
    assert rows(graph.explode_bom(spark.createDataFrame(edges, SCHEMA), "p0", rounds_untested=3)) == walk(edges, "p0")


def test_root_on_a_cycle_and_nulls(spark):
    edges = [("r", "a", 2), ("a", "r", 5), ("a", "b", 3), ("b", "a", 7), (None, "x", 1), ("b", None, 1), ("c", "d", 1)]
    assert rows(graph.explode_bom(spark.createDataFrame(edges, SCHEMA), "r")) == [("a", 2, 1), ("b", 6, 2)]
    assert rows(graph.explode_bom(spark.createDataFrame(edges, SCHEMA), "none")) == []
    assert rows(graph.explode_bom(spark.createDataFrame([], SCHEMA), "r")) == []


def test_levels_are_bounded_when_asked(spark):
    chain = spark.createDataFrame([(f"{i:02d}", f"{i + 1:02d}", 1) for i in range(8)], SCHEMA)
    with pytest.raises(ValueError, match="still growing after 5"):
        graph.explode_bom(chain, "00", max_levels=5)
    assert len(rows(graph.explode_bom(chain, "00", max_levels=8))) == 8
    assert len(rows(graph.explode_bom(chain, "00", max_levels=None, rounds_untested=2))) == 8


def test_cyclic_edges(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "b", 1), ("c", "d", 1), ("d", "e", 1), ("e", "d", 1), ("e", "f", 1), ("x", "y", 1)], SCHEMA)
    left, n = graph.cyclic_edges(edges)
    assert n == 5 and rows(left) == [("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("e", "d")]
