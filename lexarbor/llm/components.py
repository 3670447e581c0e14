"""Connected components of a link table, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _roots(parent: DataFrame) -> DataFrame:
    """(node, root) of (node, up), up < node: pointers double until all point to a root."""
    while True:
        far = parent.alias("a").join(parent.alias("b"), F.col("a.up") == F.col("b.node"), "left")
        jumped = staged(far.select(F.col("a.node").alias("node"), F.coalesce("b.up", "a.up").alias("up"), F.col("b.up").isNotNull().alias("moved")), "cc-jump")
        if jumped.where("moved").isEmpty():
            return jumped.select("node", F.col("up").alias("root"))
        parent = jumped.select("node", "up")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of (a, b) longs: each node of an edge with the least node it is connected to.

    Each round hooks every node to its least neighbour, flattens the trees by pointer doubling and relabels the edges, of
    which those inside a tree vanish. Null ends and loops are left out. No edges: no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = staged(edges, "cc-edges")
    labels = None
    while not edges.isEmpty():
        roots = _roots(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")))
        if labels is None:
            nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
        else:
            nodes = labels
        moved = nodes.alias("n").join(roots.alias("r"), F.col("n.label") == F.col("r.node"), "left")
        labels = staged(moved.select("n.node", F.coalesce("r.root", "n.label").alias("label")), "cc-labels")
        left = edges.alias("e").join(roots.alias("x"), F.col("e.a") == F.col("x.node"), "left").join(roots.alias("y"), F.col("e.b") == F.col("y.node"), "left")
        ends = left.select(F.coalesce("x.root", "e.a").alias("p"), F.coalesce("y.root", "e.b").alias("q")).where("p <> q")
        edges = staged(ends.select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct(), "cc-edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
