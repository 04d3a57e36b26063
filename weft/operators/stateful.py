"""Layers that behave differently in training: batch normalisation with moving statistics, and dropout."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions.vectors import BATCH_NORM_EPSILON, batch_norm, batch_statistics, dropout
from weft.sources.graph import Graph

from .params import Configured, table

#: Share of the old moving statistics that a call in training keeps (fixed value).
MOMENTUM = 0.99


class BatchNormalization(Configured):
    """(x - mean) / sqrt(variance + epsilon) * gamma + beta, place by place.

    Called with ``draw``, mean and variance are those of the nodes at hand (one aggregate, a job), and the moving ones follow: momentum
    times the old plus the rest times the new. Called without, the moving ones are taken. ``state`` gives them as a table, and
    ``restore`` takes them from one, so that they last from session to session.
    """

    def __init__(self, dim: int, momentum: float = MOMENTUM, epsilon: float = BATCH_NORM_EPSILON, weights: dict | None = None):
        self.dim, self.momentum, self.epsilon = dim, momentum, epsilon
        one = np.ones(dim)
        self.weights = {"gamma": one, "beta": 0 * one, "mean": 0 * one, "variance": one} | {k: np.asarray(v, float) for k, v in (weights or {}).items()}

    def __call__(self, graph: Graph, draw: int | None = None) -> DataFrame:
        if graph.dim != self.dim:
            raise ValueError(f"made for {self.dim} places, not {graph.dim}")
        w = self.weights
        mean, variance = w["mean"], w["variance"]
        if draw is not None:
            mean, variance = batch_statistics(graph.nodes, "x", self.dim)
            keep = self.momentum
            self.weights = w | {"mean": keep * w["mean"] + (1 - keep) * mean, "variance": keep * w["variance"] + (1 - keep) * variance}
        return graph.nodes.select("node", batch_norm(F.col("x"), mean, variance, w["gamma"], w["beta"], self.epsilon).alias("h"))

    def state(self, spark: SparkSession, layer: str = "batch_norm") -> DataFrame:
        return table(spark, [(layer, name, i, None, float(v)) for name, w in sorted(self.weights.items()) for i, v in enumerate(w)])

    def restore(self, state: DataFrame, layer: str = "batch_norm") -> BatchNormalization:
        rows = state.filter(F.col("layer") == layer).collect()  # four parameters a place
        for name in self.weights:
            own = sorted((r["i"], r["value"]) for r in rows if r["name"] == name)
            if len(own) != self.dim:
                raise ValueError(f"{layer} has {len(own)} values of {name}, not {self.dim}")
            self.weights[name] = np.array([v for _, v in own])
        return self


class Dropout(Configured):
    """Called with ``draw``, places fall out at the rate and the others are scaled up; without, nothing happens."""

    def __init__(self, rate: float):
        self.rate = rate

    def __call__(self, graph: Graph, draw: int | None = None) -> DataFrame:
        return graph.nodes.select("node", dropout(F.col("x"), self.rate, draw).alias("h"))
