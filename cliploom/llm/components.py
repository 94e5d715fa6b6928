"""Connected components as Spark jobs: alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.storage import stored


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``edges``: (a, b) of numbers, any direction, repeats allowed. Returns (node, component), the least node
    reachable, for every node of an edge.

    Each round sends neighbours to the least node they know; the number of rounds grows with the logarithm of
    the longest path, and a forest of stars takes one. The driver learns only whether a round was the last."""
    edges = stored(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct(), "edges")
        children = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("root"))
        roots = edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("root"))
        unsettled = children.unionByName(roots).groupBy("node").agg(F.sum("child").alias("n"), F.max("root").alias("root"))
        if unsettled.filter("n > 1 or (n = 1 and root = 1)").isEmpty():  # every node hangs on one root
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def forest(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that keep everything connected that the given pairs connect, fewer than ``size`` of them."""
    part, kept_a, kept_b = np.arange(size), [], []
    while len(a):
        high, low = np.maximum(part[a], part[b]), np.minimum(part[a], part[b])
        apart = high != low
        a, b, high, low = a[apart], b[apart], high[apart], low[apart]
        if not len(a):
            break
        chosen, first = np.unique(high, return_index=True)
        kept_a.append(a[first])
        kept_b.append(b[first])
        parent = np.arange(size)
        parent[chosen] = low[first]
        while (parent[parent] != parent).any():
            parent = parent[parent]
        part = parent[part]
    empty = np.empty(0, np.int64)
    return np.concatenate(kept_a or [empty]), np.concatenate(kept_b or [empty])
