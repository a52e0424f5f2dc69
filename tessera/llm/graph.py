"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable from each id that has a link.

    links has columns a and b. Each round points the larger neighbours of a node, then its
    smaller ones, to the smallest (large and small star); the link table never grows, and a
    chain halves each round; most_rounds is a guard that no table should meet, and meeting it raises.
    A node's neighbours are never gathered: its least neighbour is a
    map-side combined minimum, joined back."""

    def star(edges: DataFrame, name: str, large: bool) -> DataFrame:
        both = edges.union(edges.select("b", "a")).toDF("u", "v") if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-least")
        joined = both.join(least, "u")
        if large:
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        out = written(out.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        forget(least, edges)
        return out

    edges = written(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for k in range(most_rounds):
        # Done when every node's one link goes to a node without smaller neighbours.
        n, sources, deep = edges.agg(F.count("*"), F.count_distinct("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not n or (n, sources, deep) == before:
            break
        before = (n, sources, deep)
        if n == sources and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
        edges = star(star(edges, f"large-{k}", True), f"small-{k}", False)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
