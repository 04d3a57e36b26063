"""Linear attention and Performer attention over the rows of each batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.vectors import activation, concat, dense, zeros
from weft.sources.balance import SALT, heavy

from .convolutions import Conv, random_features
from .params import orthogonal

KERNEL_EPSILON = 0.001


def generalized_kernel(x: Column, matrix, kernel="relu", epsilon: float = KERNEL_EPSILON) -> Column:
    """kernel(x matrix') + epsilon."""
    return F.transform(activation(kernel)(dense(x, np.asarray(matrix, float).T)), lambda v: v + F.lit(epsilon))


def _sums(rows: DataFrame, m: int, d: int, heads: int = 1) -> DataFrame:
    """(batch, s): for each place r of the keys of each head, the sums of k_r v and of k_r; partial products in each task."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            k, v = (batch.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1) for i in (1, 2))
            for key in np.unique(keys):
                own = keys == key
                a, b = k[own].reshape(-1, heads, m), v[own].reshape(-1, heads, d)
                part = np.concatenate([np.einsum("nhm,nhd->hmd", a, b), a.sum(axis=0)[:, :, None]], axis=2).reshape(heads * m, d + 1)
                held[key] = held[key] + part if key in held else part
        for key, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * (heads * m), pa.int64()), pa.array(range(heads * m), pa.int32()), pa.array(part.tolist(), pa.list_(pa.float64()))], names=["batch", "r", "p"])

    parts = rows.mapInArrow(run, "batch long, r int, p array<double>")
    sums = parts.groupBy("batch", "r").agg(F.array(*[F.sum(F.get("p", F.lit(i))) for i in range(d)]).alias("kv"), F.sum(F.get("p", F.lit(d))).alias("k"))
    # heads times m rows a batch: a parameter's number, not the data's
    return sums.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("r", "kv", "k"))).alias("s"))


def linear_attention(rows: DataFrame, m: int, d: int, q: str = "q", k: str = "k", v: str = "v", out: str = "h", heads: int = 1) -> DataFrame:
    """(q (sum of k x v)) / (q . sum of k) in each batch and head; the mask of a row zeroes its v only.

    Columns: batch, node, q and k of width m for each head, v of width d for each head, optional boolean mask.
    The sums of a batch, its state, are one row. States and rows are merged into one stream sorted by batch, in which a
    state comes before its rows; rows are multiplied by it as matrices, an Arrow batch at a time, and none carries it.
    Batches are counted first (a job), and a large one is dealt to several tasks, each with a copy of the state.
    """
    value = F.col(v) if "mask" not in rows.columns else F.when(F.col("mask"), F.col(v)).otherwise(zeros(heads * d))
    sums = _sums(rows.select(F.col("batch").cast("long").alias("batch"), F.col(k).alias("k"), value.alias("v")), m, d, heads)
    many = heavy(rows, ["batch"])
    kept = T.StructType([f for f in rows.schema.fields if f.name != out])
    whole = F.struct(*[F.col(c) for c in kept.names]).alias("row")
    asked = many.dealt(rows).select("batch", SALT, F.lit(1).alias("kind"), F.col(q).cast("array<double>").alias("x"), whole)
    held = F.flatten(F.transform("s", lambda r: F.concat(r["kv"], F.array(r["k"]))))
    known = many.repeated(sums.withColumn("batch", F.col("batch").cast(rows.schema["batch"].dataType))).select("batch", SALT, F.lit(0).alias("kind"), held.alias("x"), F.lit(None).cast(kept).alias("row"))
    merged = asked.union(known).repartition("batch", SALT).sortWithinPartitions("batch", SALT, "kind")

    def run(batches):
        state = None
        for batch in batches:
            kind, x = batch.column(0).to_numpy(), batch.column(1)
            cut = np.append(np.flatnonzero(kind == 0), len(kind))
            at = 0
            for end in cut.tolist():  # rows up to the next state
                if end > at:
                    own = x.slice(at, end - at).flatten().to_numpy(zero_copy_only=False).reshape(end - at, heads, m)
                    both = np.einsum("nhm,hmd->nhd", own, state)
                    h = (both[:, :, :d] / both[:, :, d:]).reshape(end - at, heads * d)
                    fields = batch.column(2).slice(at, end - at).flatten()
                    places = pa.array(np.arange(0, h.size + 1, heads * d, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([*fields, pa.ListArray.from_arrays(places, pa.array(h.ravel()))], names=[*kept.names, out])
                if end < len(kind):
                    state = x[end].values.to_numpy(zero_copy_only=False).reshape(heads, m, d + 1)
                at = end + 1

    return merged.select("kind", "x", "row").mapInArrow(run, T.StructType([*kept.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


class PerformerAttention(Conv):
    """q, k, v by dense layers; random features of q and k; linear attention in each head; a dense layer last."""

    def __init__(self, channels: int, heads: int, head_channels: int | None = 64, kernel="relu", qkv_bias: bool = False, attn_out_bias: bool = True, weights=None, seed: int = 0):
        if channels % heads:
            raise ValueError("channels must be divisible by heads")
        super().__init__(weights, None, seed)
        self.channels, self.heads, self.kernel = channels, heads, kernel
        self.head_channels = head_channels or channels // heads
        self.qkv_bias, self.attn_out_bias = qkv_bias, attn_out_bias
        self.projection = self.weights.get("projection", orthogonal(random_features(self.head_channels), self.head_channels, seed))

    def __call__(self, nodes: DataFrame, dim: int) -> DataFrame:
        inner = self.heads * self.head_channels
        m = len(self.projection)
        rows = nodes
        for name in ("q", "k", "v"):
            rows = rows.withColumn(f"__{name}", dense(F.col("x"), self.weight(name, dim, inner), self.bias(f"{name}_bias", inner) if self.qkv_bias else None))
        part = lambda name, head: F.slice(f"__{name}", head * self.head_channels + 1, self.head_channels)
        lifted = lambda name: concat(*[generalized_kernel(part(name, k), self.projection, self.kernel) for k in range(self.heads)])
        rows = rows.select("batch", "node", *[c for c in ("mask",) if c in nodes.columns], lifted("q").alias("q"), lifted("k").alias("k"), F.col("__v").alias("v"))
        rows = linear_attention(rows, m, self.head_channels, heads=self.heads)
        h = dense(F.col("h"), self.weight("out", inner, self.channels), self.bias("out_bias", self.channels) if self.attn_out_bias else None)
        return rows.select("batch", "node", h.alias("h"))

