"""Connected components by contraction; edges, labels and parents stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stash


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, comp) for every node of an edge; comp is the smallest node of its component.

    Each round every node points at its smallest neighbour, pointers are followed twice, and the
    edges are rewritten between the nodes reached; a star or a clique is gone after one or two
    rounds, a chain after a logarithmic number. Sums by node combine map-side, so hubs do no harm.
    """
    edges = stash(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("up")))
        for _ in range(2):
            next_up = up.select(F.col("node").alias("up"), F.col("up").alias("far"))
            up = up.join(next_up, "up").select("node", F.col("far").alias("up"))
        up = stash(up)
        if labels is None:
            labels = up.select("node", F.col("up").alias("comp"))
        else:
            step = up.select(F.col("node").alias("comp"), F.col("up").alias("_up"))
            labels = stash(labels.join(step, "comp", "left").select("node", F.coalesce("_up", "comp").alias("comp")))
        left = up.select(F.col("node").alias("a"), F.col("up").alias("x"))
        right = up.select(F.col("node").alias("b"), F.col("up").alias("y"))
        rest = edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        edges = stash(rest)
        if edges.isEmpty():
            return labels
