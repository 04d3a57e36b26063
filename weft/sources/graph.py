"""Graphs as two tables: nodes (node, x) and edges (src, dst, w), with an optional batch key on either."""

from __future__ import annotations

import inspect
import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.vectors import doubles

from .written import written


@dataclass(frozen=True)
class Graph:
    """``dim`` is the width of x. ``keys`` are the columns that name a node: ("node",) or ("batch", "node")."""

    nodes: DataFrame
    edges: DataFrame
    dim: int

    def __post_init__(self):
        for frame, names in ((self.nodes, ("node", "x")), (self.edges, ("src", "dst"))):
            if missing := [c for c in names if c not in frame.columns]:
                raise ValueError(f"columns {missing} are missing from {frame.columns}")
        if not isinstance(self.nodes.schema["x"].dataType, T.ArrayType):
            raise ValueError("x must be an array column")
        if "w" in self.edges.columns and not isinstance(self.edges.schema["w"].dataType, T.DoubleType):
            if isinstance(self.edges.schema["w"].dataType, T.IntegralType):
                warnings.warn(f"weights of the type {self.edges.schema['w'].dataType.simpleString()} are cast to double, as features are", stacklevel=3)
            object.__setattr__(self, "edges", self.edges.withColumn("w", F.col("w").cast("double")))
        if "w" not in self.edges.columns:
            object.__setattr__(self, "edges", self.edges.withColumn("w", F.lit(1.0)))
        if self.nodes.schema["x"].dataType != T.ArrayType(T.DoubleType()):
            object.__setattr__(self, "nodes", self.nodes.withColumn("x", doubles(F.col("x"))))

    def with_features(self, nodes: DataFrame, dim: int) -> Graph:
        return replace(self, nodes=nodes, dim=dim)

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def through(self, layer, dim: int, draw: int | None = None) -> Graph:
        """The graph with a layer's output as its features, written, so that a stack of layers is planned one by one.

        With ``draw``, a seed, layers that know dropout or batch statistics are called as in training.
        """
        how = {} if draw is None or "draw" not in inspect.signature(layer).parameters else {"draw": draw}
        return self.with_features(written(layer(self, **how).withColumnRenamed("h", "x"), "layer"), dim)

    def stack(self, layers: list[tuple], draw: int | None = None) -> Graph:
        """Through each (layer, dim) in turn; every layer draws from a seed of its own."""
        graph = self
        for k, (layer, dim) in enumerate(layers):
            graph = graph.through(layer, dim, None if draw is None else 1000 * draw + k)
        return graph

    @staticmethod
    def read(spark: SparkSession, nodes: str, edges: str, dim: int | None = None) -> Graph:
        """From two Parquet tables; the width is that of the first row where it isn't given."""
        n, e = spark.read.parquet(nodes), spark.read.parquet(edges)
        if dim is None:
            first = n.select(F.size("x").alias("s")).first()
            dim = first["s"] if first else 0
        return Graph(n, e, dim)

    def write(self, nodes: str, edges: str) -> None:
        self.nodes.write.mode("overwrite").parquet(nodes)
        self.edges.write.mode("overwrite").parquet(edges)


def edge_index_to_adjacency(index: DataFrame) -> DataFrame:
    """(src, dst, w=1): repeated edges count once; direction stays, no self-loops come in."""
    return index.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct().withColumn("w", F.lit(1.0))


def nodes_of(edges: DataFrame) -> DataFrame:
    """(node) from 0 to the largest number that an edge names."""
    top = edges.agg(F.greatest(F.max("src"), F.max("dst")).alias("top")).filter("top is not null")
    return top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"))).alias("node"))


def row_normalise(nodes: DataFrame, x: str = "x") -> DataFrame:
    """Features divided by their sum of absolute values; zero rows stay."""
    size = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v))
    return nodes.withColumn(x, F.when(size > 0, F.transform(x, lambda v: v / size)).otherwise(F.col(x)))
