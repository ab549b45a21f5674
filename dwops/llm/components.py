"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dwops.session import stored_counted


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; the component is its smallest node.

    Each round points every neighbour of a node at the smallest node it knows, first the
    larger neighbours, then the smaller ones (large-star, small-star). Only minima per node
    are grouped, so a node with any number of links is combined before the shuffle; each
    round is a table in the shared folder. Rounds grow with the logarithm of a chain's length.
    Self links are allowed; rows with a NULL end are left out. No links give no rows.
    """
    edges, n = stored_counted(_ordered(links.select("a", "b").dropna()))
    seen = None
    while n:
        edges, n = stored_counted(_small_star(_large_star(edges)))
        now = (n, edges.agg(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()[0])
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, larger node first."""
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    return links.select(a, b).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    joined = edges.join(least, F.col("a") == F.col("u"))
    own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return joined.where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own).distinct()
