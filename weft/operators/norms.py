"""Normalisation layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions.vectors import normalize, vmul, vsub


def mean_subtraction(nodes: DataFrame, dim: int, x: str = "x", keys: tuple[str, ...] = ()) -> DataFrame:
    """x minus the column means over all rows (or over the rows that agree on ``keys``, for batched features)."""
    means = [F.avg(F.get(x, F.lit(i))) for i in range(dim)]
    if keys:
        rows = nodes.join(nodes.groupBy(*keys).agg(F.array(*means).alias("__mean")), list(keys))
    else:
        rows = nodes.crossJoin(F.broadcast(nodes.agg(F.array(*means).alias("__mean"))))  # one row
    return rows.withColumn("h", vsub(F.col(x), F.col("__mean"))).drop("__mean")


def message_norm(nodes: DataFrame, messages: DataFrame, x: str = "x", msg: str = "msg", p: float = 2, scale: float = 1.0) -> DataFrame:
    """(node, h): the unit vector of the message times that of x, place by place, times the scale."""
    rows = nodes.select("node", F.col(x).alias("__x")).join(messages.select("node", F.col(msg).alias("__m")), "node")
    h = vmul(normalize(F.col("__m"), p), normalize(F.col("__x"), p))
    return rows.select("node", F.transform(h, lambda v: v * F.lit(float(scale))).alias("h"))
