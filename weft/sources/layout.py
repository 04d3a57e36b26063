"""Edges laid out once for rounds of products: co-partitioned with the states, so that a round moves states only.

Edges are written in buckets of the end that is looked up, states in buckets of the node, with as many buckets as shuffle
partitions. A round then joins both without moving either; what moves are the partial sums by the other end, once, and they
arrive in the partitions that the next states are written in. Edges of heavy nodes (``Hubs``, at most ``SHARE`` times the
partitions) would fill a bucket: they are written apart, in buckets of the other end, and meet the states of
those nodes, which are sent to all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.segments import keep_all, reduce_vectors
from weft.functions.vectors import vscale

from .balance import LEAST, SHARE
from .written import bucketed


class Layout:
    """Edges (src, dst, w) for products that gather at ``to`` what ``of`` holds. Making one writes the edges."""

    def __init__(self, edges: DataFrame, of: str = "dst", to: str = "src", least: int = LEAST):
        self.of, self.to = of, to
        spark = edges.sparkSession
        partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = bucketed(edges.select("src", "dst", "w"), of, "edges")
        counts = rows.groupBy(of).agg(F.count(F.lit(1)).alias("n"))
        whole = counts.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()  # one row
        limit = max(least, (whole["rows"] or 0) // (partitions * SHARE))
        few = (whole["most"] or 0) > limit
        self.hubs = [r[of] for r in counts.filter(F.col("n") > limit).select(of).collect()] if few else []  # SHARE * partitions rows
        hub = F.col(of).isin(self.hubs)
        self.plain = rows.filter(~hub) if self.hubs else rows
        self.dealt = bucketed(rows.filter(hub), to, "hubs") if self.hubs else None

    def gathered(self, states: DataFrame, x: str) -> DataFrame:
        """(node, w, v): a row for each edge, with the vector of its ``of``, under its ``to``."""
        side = states.select(F.col("node").alias(self.of), F.col(x).alias("v"))
        pick = lambda met: met.select(F.col(self.to).alias("node"), "w", "v")
        met = pick(self.plain.join(side, self.of))
        if self.dealt is None:
            return met
        few = F.broadcast(side.filter(F.col(self.of).isin(self.hubs)))  # a row a hub
        return met.union(pick(self.dealt.join(few, self.of)))

    def product(self, states: DataFrame, x: str, dim: int, out: str = "h", keep: tuple[str, ...] = (), how="sum", weigh: bool = True, fill: float = 0.0) -> DataFrame:
        """(node, keep, out): the vectors over each node's edges, times w if asked for, reduced; nodes without edges get the fill."""
        met = self.gathered(states, x).withColumn("v", vscale(F.col("v"), F.col("w")) if weigh else F.col("v"))
        found = reduce_vectors(met.select("node", "v"), ["node"], "v", dim, how, out)
        return keep_all(states.select("node", *keep), found, ["node"], {out: F.array_repeat(F.lit(float(fill)), dim)})


def states(df: DataFrame, name: str = "states", aligned: bool = False) -> DataFrame:
    """``df`` written in buckets of ``node``; ``aligned`` where it comes from a product of states."""
    return bucketed(df, "node", name, aligned)
