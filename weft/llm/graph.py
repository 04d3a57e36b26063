"""Connected components of a distributed edge list, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of the long columns ``a`` and ``b``; root is the smallest node reached.

    Every round takes the smallest label among a node and its neighbours and then the label's own
    label, so that chains halve. Labels and edges stay in tables; the driver sees one count a round.
    """
    edges = edges.filter("a <> b")
    both = durable(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        new = labels.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "near").alias("next"))
        far = labels.select(F.col("node").alias("at"), F.col("root").alias("far"))
        new = new.join(far, F.col("next") == F.col("at"), "left").select("node", "root", F.least("next", F.coalesce("far", "next")).alias("next"))
        new = durable(new, "labels")
        moved = new.filter("next <> root").limit(1).count()
        labels = new.select("node", F.col("next").alias("root"))
        if not moved:
            return labels
