"""Connected components of a graph of links, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _to_roots(hop: DataFrame) -> DataFrame:
    """``hop`` (node, root), a forest, with each node's topmost root: paths double until nothing moves."""
    while True:
        above = hop.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = materialise(hop.select("node", "root").join(above, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "forest")
        discard(hop)
        hop = new
        if hop.where("moved").limit(1).count() == 0:
            return hop


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long): root is the smallest node reachable.

    Each round a node points to its smallest neighbour if that is smaller than itself, the trees that this makes are
    compressed to their roots, and links between roots go on to the next round; links within a tree are done. Sums by node
    are combined before the shuffle, so a node with very many links costs its links once. Tables are written each round.
    Self-links, repeated links and an empty table are allowed.
    """
    both = links.select("a", "b").where("a <> b")
    edges = materialise(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = None
    for _ in range(most_rounds):
        hop = _to_roots(materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "forest")).select("node", "root")
        if labels is None:
            labels = hop
        else:
            labels = materialise(labels.join(hop.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        between = edges.join(hop.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(hop.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        left = materialise(between.where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        discard(edges)
        edges = left
        if edges.limit(1).count() == 0:
            return labels
    raise RuntimeError(f"no end after {most_rounds} rounds")
