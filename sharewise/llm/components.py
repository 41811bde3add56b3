"""Connected components of a table of links, as Spark jobs.

Alternating large-star and small-star rounds: each is an aggregate and a join, the links shrink
towards stars, and every round is written to the shared folder, so lineage stays short and a
lost executor costs a round at most. Nothing but the count of links and a checksum reaches the
driver: nodes are shuffled, whatever Catalyst takes their size to be. A node that a large part of
all links meet in (the centre of a star) is split by the lookup, so no task gets all of its links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharewise.operators.joins import salted_join
from sharewise.session import stage


def _with_least(edges: DataFrame) -> DataFrame:
    """``u, v, least``: each link and the smallest neighbour of its ``u``."""
    nodes = edges.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("__n"))
    least = nodes.drop("__n")
    return salted_join(edges, least, "u", ["v"], how="inner", counts=nodes, shuffled=True)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = _with_least(both).filter("v > u")
    return moved.select(F.col("v").alias("u"), F.least("least", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of these neighbours."""
    found = _with_least(edges)
    # The link to the least neighbour itself stays, all others turn to it.
    moved = F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v"))
    return found.select(moved.alias("u"), F.col("least").alias("v")).distinct()


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node that has a link.

    Links are undirected, may repeat and may join a node with itself. Nodes without any other
    are not returned. No link, no row.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    links = stage(links.filter("u <> v").distinct(), "links")
    seen = None
    while True:
        code = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        now = links.agg(F.count("*"), code).first()
        if now == seen or not now[0]:
            break
        seen = now
        links = stage(_small_star(_large_star(links)), "links")
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
