"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weekcraft.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (u, v): the root is the least node of its component.

    Rounds of large-star and small-star steps: each node's higher neighbours, then its lower ones,
    are linked to the least node around it, which keeps components and flattens them in few rounds.
    Minima are summed before the shuffle and written; both sides of the joins back are written
    tables, so AQE splits a node with very many neighbours. Every round is a written table in the shared folder.
    """
    links = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = materialize(both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large_star")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        links = materialize(small, "small_star")
        # A forest of stars is done: no node has two parents, and no parent has a parent.
        inner = links.select(F.col("v").alias("u")).distinct().join(links, "u", "leftsemi").limit(1).count()
        twice = links.groupBy("u").count().where("count > 1").limit(1).count() if not inner else 1
        if not inner and not twice:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
