"""Hierarchies, parts lists and lineage."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType

from dwops.plans.frontier import expand
from dwops.session import stored, stored_counted


def walk_hierarchy(df: DataFrame, key: str, parent: str, name: str, max_levels: int = 100, sep: str = " > ") -> DataFrame:
    """Every node reachable from the roots (parent NULL): level from 1, id path, name path.

    A node already on its own path is not entered again, so cycles end.
    """
    nodes = df.select(F.col(key).alias("id"), F.col(parent).alias("parent"), F.col(name).alias("name"))
    roots = nodes.where(F.col("parent").isNull()).select(
        "id", "parent", "name", F.lit(1).cast("long").alias("level"), F.array("id").alias("path"), F.col("name").alias("name_path")
    )

    def down(frontier, _, __):
        above = frontier.select(F.col("id").alias("parent"), "level", "path", "name_path")
        below = nodes.join(above, "parent").where(~F.array_contains("path", F.col("id")))
        return below.select(
            "id", "parent", "name", (F.col("level") + 1).alias("level"), F.concat("path", F.array("id")).alias("path"),
            F.concat("name_path", F.lit(sep), F.col("name")).alias("name_path"),
        )

    return expand(roots, down, max_levels, stop_quietly=False)


def subtree_totals(walked: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """Sum of ``value`` over each node and everything below it, and the number of such nodes."""
    members = walked.select(F.col("id").alias("_member"), F.explode("path").alias("id"))
    amounts = values.select(F.col("id").alias("_member"), value)
    return members.join(amounts, "_member").groupBy("id").agg(
        F.sum(value).cast("double").alias("subtree_total"), F.count(F.lit(1)).alias("subtree_nodes")
    )


def check_levels(df: DataFrame, key: str, parent: str, level: str) -> DataFrame:
    """Nodes whose stored level is not their depth, including those no root leads to."""
    walked = walk_hierarchy(df, key, parent, key).groupBy("id").agg(F.min("level").alias("true_level"))
    stored = df.select(F.col(key).alias("id"), F.col(level).alias("stored_level"))
    return stored.join(walked, "id", "left").where(~F.col("stored_level").eqNullSafe(F.col("true_level")))


QUANTITY = "decimal(38,0)"
# Rounds an expansion takes before the edges are tested for cycles, which shallow lists never need.
ROUNDS_UNTESTED = 16


def cyclic_edges(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges (part_id, component_id) that lie on a cycle or between two of them, and how many.

    Round by round the edges go whose part is no component of an edge left, then those
    whose component is no part: what is left feeds itself on both sides.
    """
    left, n = stored_counted(edges.select("part_id", "component_id").where("part_id is not null and component_id is not null").distinct())
    for here, there in (("part_id", "component_id"), ("component_id", "part_id")):
        while n:
            known = left.select(F.col(there).alias(here)).distinct()
            kept, still = stored_counted(left.join(known, here, "left_semi").select("part_id", "component_id"))
            if still == n:
                break
            left, n = kept, still
    return left, n


def explode_bom(edges: DataFrame, root, max_levels: int | None = 100, rounds_untested: int = ROUNDS_UNTESTED) -> DataFrame:
    """Total quantity and greatest depth of each component under a root part.

    ``edges``: (part_id, component_id, quantity). Quantities multiply down a path and add up
    over paths. A layer holds one row per component reached by paths of its length, with the
    quantities of all these paths added up, so the work is layers x edges and not paths. A
    component already on its path is not entered again; only for the components that lie on
    cycles does a row have to know which of them it has passed, and a test for cycles finds
    those, once an expansion has gone on for ``rounds_untested`` layers or more than there are edges.
    """
    used = stored(edges.select("part_id", "component_id", F.col("quantity").cast(QUANTITY).alias("quantity")).where("part_id is not null and component_id is not null"))
    kind = used.schema["component_id"].dataType

    def layers(core: DataFrame | None, rounds: list[DataFrame], limit: int | None) -> bool:
        """Add layers until nothing comes; True if the limit was reached before."""
        below = used if core is None else used.join(core.select(F.col("node").alias("component_id"), F.lit(True).alias("_core")), "component_id", "left")
        nothing = F.array().cast(ArrayType(kind))
        start = nothing
        if core is not None and core.where(F.col("node") == F.lit(root)).count():
            start = F.array(F.lit(root).cast(kind))

        def step(above: DataFrame) -> DataFrame:
            met = below.join(above, "part_id")
            if core is None:
                passed = F.col("passed")
            else:
                met = met.where(~F.array_contains("passed", F.col("component_id")))
                # Which ones were passed matters, not in what order.
                passed = F.when(F.col("_core"), F.array_sort(F.concat("passed", F.array("component_id")))).otherwise(F.col("passed"))
            return met.groupBy("component_id", passed.alias("passed")).agg(F.sum((F.col("_q") * F.col("quantity")).cast(QUANTITY)).cast(QUANTITY).alias("quantity"))

        for level in count(len(rounds) + 1):
            if not rounds:
                above = used.sparkSession.range(1).select(F.lit(root).cast(kind).alias("part_id"), start.alias("passed"), F.lit(1).cast(QUANTITY).alias("_q"))
            else:
                above = rounds[-1].select(F.col("component_id").alias("part_id"), "passed", F.col("quantity").alias("_q"))
            reached = step(above).where(F.col("component_id") != F.lit(root)).withColumn("level", F.lit(level).cast("long"))
            if limit is not None and level > limit:
                return not reached.isEmpty()
            reached, found = stored_counted(reached)
            rounds.append(reached)
            if not found:
                return False

    limits, rounds = [n for n in (max_levels, min(rounds_untested, used.count())) if n is not None], []
    if layers(None, rounds, max(min(limits), 1)):
        core, n = cyclic_edges(used)
        if n:  # start again, now that the components which may come twice are known
            rounds, core = [], stored(core.select(F.col("part_id").alias("node")).union(core.select("component_id")).distinct())
        if layers(core if n else None, rounds, max_levels):
            raise ValueError(f"still growing after {max_levels} levels: deeper than expected")
    return reduce(DataFrame.unionByName, rounds).groupBy("component_id").agg(F.sum("quantity").cast("long").alias("total_quantity"), F.max("level").alias("max_depth"))


# Nodes that may be sent to every task. Spark judges a stored table by its compressed size, which says little of names that are alike.
SENT_NODES = 500_000


def trace_lineage(sources: dict[str, DataFrame], start: DataFrame, direction: str = "up", max_rounds: int | None = None) -> DataFrame:
    """Names reached from a start set over several edge sources: (node, round, via).

    Each round follows all edge sources from the newly found names and keeps the unseen
    ones; it ends when none appear, or after ``max_rounds`` if that is given. ``via`` is the (first) source
    that led there, NULL for the start.
    """
    if direction not in ("up", "down"):
        raise ValueError(f"unknown direction {direction!r}")
    here, there = ("dst", "src") if direction == "up" else ("src", "dst")
    # Sources go by their place in name order: the first of some numbers is kept in a hash table, that of texts takes a sort of all edges met.
    names = sorted(sources)
    tagged = [sources[n].select(F.col(here).alias("_here"), F.col(there).alias("node")).distinct().withColumn("via", F.lit(i)) for i, n in enumerate(names)]
    # Read in every round, so reduced and stored once.
    edges = stored(reduce(DataFrame.unionByName, tagged))
    seeds = start.select("node").distinct().select("node", F.lit(0).cast("long").alias("round"), F.lit(None).cast("int").alias("via"))

    def follow(frontier, earlier, number):
        met = frontier.select(F.col("node").alias("_here"))
        if met.count() > SENT_NODES:
            met = met.hint("shuffle_hash")
        reached = edges.join(met, "_here").select("node", "via", F.lit(False).alias("_seen"))
        # Known nodes take part in the grouping; an anti join is pushed below it and looks at every edge.
        seen = [r.select("node", "via", F.lit(True).alias("_seen")) for r in earlier]
        grouped = reduce(DataFrame.unionByName, seen, reached).groupBy("node").agg(F.min("via").alias("via"), F.bool_or("_seen").alias("_seen"))
        return grouped.where("not _seen").select("node", F.lit(number).cast("long").alias("round"), "via")

    found = expand(seeds, follow, max_rounds, stop_quietly=True)
    return found.withColumn("via", F.get(F.array(*map(F.lit, names)), "via"))
