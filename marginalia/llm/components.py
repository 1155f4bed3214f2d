"""Connected components of links between documents, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import written


#: A node with more than this share of all edges is a hub; there are at most twice its inverse.
HUB = 1 / 500
#: Edges up to which hubs need no care: a join task takes them all (16 bytes each), and plans stay small on the driver.
HUB_EDGES = 1_000_000


def _with_least(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """(edges (a, b) with m, the least b of their a; a, m of all nodes).

    Beyond HUB_EDGES the edges of a hub meet its row by broadcast, of at most 2 / HUB rows, so that no join task gets a hub.
    """
    if total <= HUB_EDGES:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        return edges.join(least, "a"), least
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("edges"))
    hubs = F.broadcast(least.where(F.col("edges") > max(total * HUB, 1_000)).select("a", F.col("m").alias("hub_m")))
    own = edges.join(hubs, "a", "left")
    few = own.where("hub_m is null").select("a", "b").join(least.select("a", "m"), "a")
    return few.union(own.where("hub_m is not null").select("a", "b", "hub_m")), least.select("a", "m")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b: long).

    Large-star and small-star rounds until no edge changes: a node's neighbours are tied to the smallest of them.
    A round is two aggregations with map-side combination and two joins, hubs apart;
    the edges, never more than at first, are written to the shared folder after each round.
    """
    own = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = written(own, "edges"), None
    while True:
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if not now[0] or now == seen:
            break
        seen = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tied, _ = _with_least(both, now[0])
        large = tied.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        tied, least = _with_least(large, now[0])
        small = tied.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
