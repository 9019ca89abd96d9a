"""Connected components of links as DataFrames, by alternating large and small stars.

Each round hangs every node's neighbours on its least neighbour; edges only ever point to smaller nodes, so the rounds
end in stars whose centres are the least nodes. Hubs are no group that is collected: minima are
aggregated before the shuffle and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    hung = both.filter("b > a").join(least, "a")
    return hung.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges point from a larger node a to a smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    hung = edges.join(least, "a")
    moved = hung.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(hung.select("a", F.col("least").alias("b")))
    return moved.filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) for each node that has a link; links: (a, b). The root is the least node reachable, itself included."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = scratch.write(edges, f"{name}-0")
    state, k = _state(edges), 0
    while True:
        k += 1
        edges = scratch.write(_small_star(_large_star(edges)), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))
