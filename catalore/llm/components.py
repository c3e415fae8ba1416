"""Connected components of links that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalore.session import cut_lineage

#: Rounds after which a graph that still changes is an error; rounds needed grow with the
#: logarithm of the number of nodes.
MOST_ROUNDS = 60


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of node and neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = cut_lineage(least)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = cut_lineage(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.withColumnRenamed("m", "v"))


def state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, least) for every node of the links (u, v): the least node it can reach.

    Alternating star steps turn each component into a star around its least node. Each
    round is written to the shared folder; the rounds compare a count and a hash. The
    least neighbours are written by themselves, so that their join with the links can
    split a node that has very many.
    """
    edges = cut_lineage(edges.filter("u <> v").select("u", "v").distinct())
    before = state(edges)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        edges = cut_lineage(large_star(small_star(edges)).distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components still change after {MOST_ROUNDS} rounds")
    stars = edges.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("least"))
    centres = stars.select(F.col("least").alias("node"), "least").distinct()
    return stars.unionByName(centres)
