"""Connected components of a table of edges, in DataFrame operations.

Each node takes the smallest label among its own, its neighbours' and its label's
label (pointer jumping), until nothing changes. Labels are written to the shared
folder in every round, which cuts the lineage, and both sides of every join are
plain exchanges, so a node with very many edges is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node reachable. ``edges``: (a, b) longs; nodes without an edge are not in the result."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        there = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        near = both.join(there, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        moved = labels.join(jump, "label").select("node", "label", "far").join(near, "node")
        new = stored(moved.select("node", F.least("label", "far", "near").alias("label"), (F.least("far", "near") < F.col("label")).alias("changed")), "labels")
        labels = new.select("node", "label")
        if new.where("changed").limit(1).count() == 0:
            return labels
