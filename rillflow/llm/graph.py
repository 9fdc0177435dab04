"""Connected components of a large undirected graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Stash


def roots(pointers: DataFrame, stash: Stash, tag: str) -> DataFrame:
    """(key, comp) for pointers (key, up) that lead, without a cycle, to vertices that point to themselves: where each ends.

    Pointers are followed three at a time, and a table is written after each such jump. A hot vertex (the middle of a large
    star) is split by the adaptive skew join.
    """
    turn, up = 0, stash.put(f"{tag}-up0", pointers.select("key", "up"))
    while True:
        of = up.select(F.col("key").alias("up"), F.col("up").alias("top"))
        twice = of.join(of.select(F.col("up").alias("top"), F.col("top").alias("last")), "top").select("up", "top", "last")
        after = up.join(twice, "up").select("key", F.col("last").alias("up"), (F.col("last") != F.col("top")).alias("moved"))
        turn, after = turn + 1, stash.put(f"{tag}-up{turn + 1}", after)
        stash.drop(f"{tag}-up{turn - 1}")
        up = after.select("key", "up")
        if after.where("moved").isEmpty():
            return up.withColumnRenamed("up", "comp")


def components(edges: DataFrame, stash: Stash, tag: str) -> DataFrame:
    """(key, comp) for each vertex of ``edges`` (a, b); comp is a vertex of the same component.

    Each round every vertex points to its smallest neighbour, pointers are followed to their roots, and edges are rewritten
    between roots; a round at least halves the vertices that still have edges. All steps are joins and partial
    aggregations. Self-loops and repeated edges are harmless.
    """
    labels: DataFrame | None = None
    left = stash.put(f"{tag}-edges0", edges.select("a", "b").where("a <> b").distinct())
    turn = 0
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("low"))
        parent = roots(low.select("key", F.least("key", "low").alias("up")), stash, f"{tag}-{turn}").withColumnRenamed("comp", "up")
        roots_a = parent.select(F.col("key").alias("a"), F.col("up").alias("ra"))
        roots_b = parent.select(F.col("key").alias("b"), F.col("up").alias("rb"))
        rest = left.join(roots_a, "a").join(roots_b, "b").where("ra <> rb")
        rest = rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        after = stash.put(f"{tag}-edges{turn + 1}", rest)
        stash.drop(f"{tag}-edges{turn}")
        if labels is None:
            labels = parent.select("key", F.col("up").alias("comp"))
        else:
            labels = relabel(labels, parent.select("key", F.col("up").alias("comp")))
            labels = stash.put(f"{tag}-labels{turn}", labels)
        left, turn = after, turn + 1
    stash.drop(f"{tag}-edges{turn}")
    if labels is None:
        return edges.select(F.col("a").alias("key"), F.col("b").alias("comp")).limit(0)
    return labels


def relabel(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels (key, comp) with each comp replaced by what ``more`` says of it, if anything."""
    top = more.select(F.col("key").alias("comp"), F.col("comp").alias("top"))
    return labels.join(top, "comp", "left").select("key", F.coalesce("top", "comp").alias("comp"))
