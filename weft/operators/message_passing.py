"""Message passing: gather along edges, compute a message, reduce onto targets, update nodes.

Subclasses override ``message`` and ``update`` with functions of columns. Weights only say which edges
are there. Every node of the graph stays; what no message reaches holds the reduction's fill.
"""

from __future__ import annotations

import inspect
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.segments import FILLS, keep_all, reduce_vectors, reduced_dim, reducer, reducer_name
from weft.functions.vectors import activation
from weft.sources.balance import heavy
from weft.sources.graph import Graph

from .params import Configured


@dataclass
class EdgeContext:
    """What a message may use: node columns of the source and of the target, and columns of the edge."""

    columns: list[str]
    used: set[str] = field(default_factory=set)

    def source(self, name: str = "x") -> Column:
        self.used.add("source")
        return F.col(f"s_{name}")

    def target(self, name: str = "x") -> Column:
        self.used.add("target")
        return F.col(f"t_{name}")

    def edge(self, name: str = "e") -> Column:
        if name not in self.columns:
            raise ValueError(f"edges have no column {name!r}")
        return F.col(f"e_{name}")


class MessagePassing(Configured):
    def __init__(self, aggregate="sum", activation=None):
        reducer(aggregate)
        self.aggregate, self.activation = aggregate, activation

    # hooks
    def message(self, c: EdgeContext) -> Column:
        return c.source("x")

    def update(self, h: Column) -> Column:
        return h

    def message_dim(self, graph: Graph) -> int:
        return graph.dim

    def fill(self) -> float:
        return FILLS.get(reducer_name(self.aggregate)) or 0.0

    # engine
    def get_inputs(self, graph: Graph) -> Graph:
        if "batch" in graph.edges.columns or "batch" in graph.nodes.columns:
            raise ValueError("message passing takes one graph, without a batch key")
        return graph

    def gather(self, graph: Graph, columns: list[str], needed: set[str]) -> DataFrame:
        """Edges with the node columns of their sources (s_), targets (t_), and their own (e_).

        Edges are counted by each end that is needed (a job), and those of a hub are dealt to several tasks.
        """
        own = [c for c in graph.edges.columns if c not in ("src", "dst")]
        out = graph.edges.filter("w <> 0").select("src", "dst", *[F.col(c).alias(f"e_{c}") for c in own])
        for side, key, letter in (("source", "src", "s"), ("target", "dst", "t")):
            if side in needed:
                table = graph.nodes.select(F.col("node").alias(key), *[F.col(c).alias(f"{letter}_{c}") for c in columns])
                out = heavy(graph.edges, [key]).join(out, table)
        return out

    def propagate(self, graph: Graph, message=None, **more) -> DataFrame:
        """(nodes' columns, agg): the reduced messages of every node. A message gets those of ``more`` that it names."""
        columns = [c for c in graph.nodes.columns if c != "node"]
        context = EdgeContext(graph.edges.columns)
        f = message or self.message
        wanted = list(inspect.signature(f).parameters.values())[1:]
        if missing := [p.name for p in wanted if p.default is p.empty and p.kind is p.POSITIONAL_OR_KEYWORD and p.name not in more]:
            raise ValueError(f"the message asks for {missing}, which propagate wasn't given")
        m = f(context, **{p.name: more[p.name] for p in wanted if p.name in more})
        edges = self.gather(graph, columns, context.used)
        dim = self.message_dim(graph)
        found = reduce_vectors(edges.select(F.col("dst").alias("node"), m.alias("__m")), ["node"], "__m", dim, self.aggregate, "agg")
        return keep_all(graph.nodes, found, ["node"], {"agg": F.array_repeat(F.lit(float(self.fill())), reduced_dim(self.aggregate, dim))})

    def __call__(self, graph: Graph) -> DataFrame:
        graph = self.get_inputs(graph)
        out = self.propagate(graph)
        return out.select("node", activation(self.activation)(self.update(F.col("agg"))).alias("h"))

    @staticmethod
    def preprocess(edges: DataFrame, nodes: DataFrame) -> DataFrame:
        return edges

    def config(self) -> dict:
        return super().config() | {"aggregate": reducer_name(self.aggregate)}
