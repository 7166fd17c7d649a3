"""Connected components of an edge table, each named by its smallest node."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from moundlens.llm.common import durable


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of `edges` (a, b long): root is the smallest node reachable.

    Each round hangs every node under its smallest neighbour, follows these links to their ends by
    doubling, and contracts the edges to the ends. Every node with an edge merges with another, so
    the nodes left at least halve in a round, also along chains. All tables are written before they
    are read again; minima are taken before any shuffle, so a node with very many edges is cheap.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    left = durable(_open(both), f"{name}-edges")
    known: DataFrame | None = None
    while not left.isEmpty():
        ends = left.union(left.select("v", "u")).toDF("u", "v")
        up = ends.groupBy("u").agg(F.min("v").alias("v"))
        up = durable(up.select(F.col("u").alias("node"), F.least("u", "v").alias("root")), f"{name}-up")
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            jumped = durable(
                up.join(above, "root").select("node", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")),
                f"{name}-jump",
            )
            up = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        if known is None:
            known = up
        else:
            mid = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            known = durable(
                known.join(mid, "root", "left").select("node", F.coalesce("top", "root").alias("root")),
                f"{name}-known",
            )
        to = up.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        left = left.join(to, "u").select("v", F.col("ru").alias("u"))
        to = up.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        left = durable(_open(left.join(to, "v").select("u", F.col("rv").alias("v"))), f"{name}-edges")
    return known if known is not None else both.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _open(edges: DataFrame) -> DataFrame:
    low, high = F.least("u", "v"), F.greatest("u", "v")
    return edges.where("u <> v").select(low.alias("u"), high.alias("v")).distinct()
