"""Connected components of an edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, keep) -> DataFrame:
    """(node, component) of every node of edges (a, b); a component is named by its least node.

    Two nodes that only have each other are settled at once. Then each round hangs the larger neighbours of a node on the
    least node around it, and after that all smaller ones, so that trees halve their depth. Minima are combined before the
    shuffle, so a node with very many neighbours is one key of a join that can be split, and no group is collected.
    keep() writes what a round leaves, and a sum over the hashes of its edges tells whether anything changed.
    """
    every = keep(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    ends = every.where("hi <> lo").select(F.explode(F.array(F.struct(F.col("hi").alias("node"), F.col("lo").alias("other")), F.struct(F.col("lo").alias("node"), F.col("hi").alias("other")))).alias("e")).select("e.*")
    # a node with one neighbour, and that neighbour with this one only: both ends of the pair have one end each
    lone = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("other").alias("other")).where("n = 1")
    pairs = lone.groupBy(F.greatest("node", "other").alias("hi"), F.least("node", "other").alias("lo")).agg(F.count("*").alias("n")).where("n = 2").select("hi", "lo")
    pairs = keep(pairs)
    tree = every.where("hi <> lo").join(pairs, ["hi", "lo"], "left_anti")
    before = None
    while True:
        both = tree.unionByName(tree.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("m"))
        # the larger neighbours of a node hang on the least node around it
        large = both.join(least, "hi").where(F.col("lo") > F.col("hi")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        # a node and its smaller neighbours hang on the least of them
        small = large.join(lowest, "hi")
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(small.select("hi", F.col("m").alias("lo")))
        tree = keep(small.where("hi <> lo").distinct())
        now = tree.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    hung = tree.unionByName(pairs).select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    roots = hung.select(F.col("component").alias("node"), "component").union(every.where("hi = lo").select("hi", "lo")).distinct()
    alone = roots.join(hung, "node", "left_anti")
    return hung.unionByName(alone)
