"""Connected components of a graph given as edges, by Spark jobs.

Alternating star steps: each node's larger neighbours are linked to its
smallest one, then each node and its smaller neighbours to the smallest. A
node's neighbours are never gathered; a round is two aggregations and joins by
node, and its edges are written to the shared folder. Rounds end when no edge
changes; their number grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revlens.llm.common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = both.where("b > a").join(least, "a")
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # here a > b in every edge
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the component is
    its smallest node. Self-loops count as nodes."""
    edges = stage(edges.select("a", "b"), "edges")
    loops = edges.where("a = b").select("a").distinct()
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        links = stage(_small_star(_large_star(links)), "edges")
        now = links.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.countDistinct("a").alias("d")).first()
        if now["n"] == now["d"] and tuple(now) == state:
            break
        state = tuple(now)
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    known = found.unionByName(roots)
    alone = loops.join(known, loops["a"] == known["node"], "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    return known.unionByName(alone)
