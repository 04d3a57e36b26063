"""Degrees, normalisation, Laplacians and products of sparse adjacency tables (src, dst, w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.segments import keep_all, reduce_vectors
from weft.functions.vectors import NORM_EPSILON, vscale, zeros
from weft.sources.balance import heavy
from weft.sources.written import written


def _keys(frame: DataFrame) -> list[str]:
    return ["batch"] if "batch" in frame.columns else []


def source_target(edges: DataFrame, keep_explicit_zeros: bool = False) -> DataFrame:
    """(src, dst) of the entries that are not 0; of all stored entries if asked for."""
    return (edges if keep_explicit_zeros else edges.filter("w <> 0")).select(*_keys(edges), "src", "dst")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, degree): sums of the weights that leave each node, 0 where none does."""
    keys = [*(k for k in _keys(edges) if k in nodes.columns), "node"]
    out = edges.withColumnRenamed("src", "node").groupBy(*keys).agg(F.sum("w").alias("degree"))
    return keep_all(nodes.select(*keys), out, keys, {"degree": F.lit(0.0)})


def degree_matrix(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The degrees as a diagonal (src, dst, w)."""
    return _diagonal(degrees(edges, nodes), F.col("degree"))


def _diagonal(frame: DataFrame, value: Column) -> DataFrame:
    return frame.select(*_keys(frame), F.col("node").alias("src"), F.col("node").alias("dst"), value.cast("double").alias("w"))


def _power(degree: Column, k: float) -> Column:
    """degree^k with infinity turned to 0; a negative degree to a broken power stays NaN."""
    p = F.pow(degree, F.lit(float(k)))
    return F.when((degree == 0) & F.lit(k < 0), 0.0).when(F.abs(p) == float("inf"), 0.0).otherwise(p)


def degree_power(edges: DataFrame, nodes: DataFrame, k: float) -> DataFrame:
    """The degrees to the power k as a diagonal (src, dst, w)."""
    return _diagonal(degrees(edges, nodes), _power(F.col("degree"), k))


def _scaled(edges: DataFrame, by_src: DataFrame, by_dst: DataFrame | None, value) -> DataFrame:
    """Edges whose weight is value(w, p of src, p of dst)."""
    keys = _keys(edges)
    out = edges.join(by_src.select(*keys, F.col("node").alias("src"), F.col("p").alias("__ps")), [*keys, "src"])
    if by_dst is not None:
        out = out.join(by_dst.select(*keys, F.col("node").alias("dst"), F.col("p").alias("__pd")), [*keys, "dst"])
    own = [c for c in edges.columns if c not in (*keys, "src", "dst", "w")]
    pd = F.col("__pd") if by_dst is not None else F.lit(1.0)
    return out.select(*keys, "src", "dst", value(F.col("w"), F.col("__ps"), pd).alias("w"), *own)


def normalize(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """w / (sqrt(degree of src) + 1e-7) / (sqrt(degree of dst) + 1e-7), out-degrees on both sides."""
    d = degrees(edges, nodes).withColumn("p", F.sqrt("degree") + F.lit(NORM_EPSILON))
    return _scaled(edges, d, d, lambda w, a, b: w / a / b)


def normalized_adjacency(edges: DataFrame, nodes: DataFrame, symmetric: bool = True) -> DataFrame:
    """D^-1/2 A D^-1/2, or D^-1 A; rows and columns of degree 0 become 0."""
    d = degrees(edges, nodes).withColumn("p", _power(F.col("degree"), -0.5 if symmetric else -1.0))
    return _scaled(edges, d, d if symmetric else None, lambda w, a, b: w * a * b)


def _summed(*frames: DataFrame) -> DataFrame:
    keys = _keys(frames[0])
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy(*keys, "src", "dst").agg(F.sum("w").alias("w"))


def _negative(edges: DataFrame) -> DataFrame:
    return edges.select(*_keys(edges), "src", "dst", (-F.col("w")).alias("w"))


def laplacian(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """D - A; self-loops merge with the diagonal."""
    return _summed(degree_matrix(edges, nodes), _negative(edges))


def normalized_laplacian(edges: DataFrame, nodes: DataFrame, symmetric: bool = True) -> DataFrame:
    """I - normalised A, with the diagonal of every node."""
    return _summed(_diagonal(nodes, F.lit(1.0)), _negative(normalized_adjacency(edges, nodes, symmetric)))


def gcn_filter(edges: DataFrame, nodes: DataFrame, symmetric: bool = True) -> DataFrame:
    """A + I, normalised; a self-loop that is there gains 1. The input stays as it is.

    The sum is written, as its degrees and both of its ends are looked at.
    """
    with_loops = _summed(edges.select(*_keys(edges), "src", "dst", "w"), _diagonal(nodes, F.lit(1.0)))
    return normalized_adjacency(written(with_loops, "loops"), nodes, symmetric)


def adj_matmul(edges: DataFrame, nodes: DataFrame, x: str, dim: int, transpose: bool = False, out: str = "h", keep: tuple[str, ...] = ()) -> DataFrame:
    """(node, keep, out) of A x (or A' x): out[src] = sum of w * x[dst]; nodes without edges get zeros.

    Single, batched and mixed products: the batch key joins where both sides have it, and is carried
    along where only one side has it. Edges are counted by the end that is looked up (a job), and those of a hub are
    dealt to several tasks.
    """
    a, b = ("dst", "src") if transpose else ("src", "dst")
    both = [k for k in _keys(edges) if k in nodes.columns]
    keys = list(dict.fromkeys([*_keys(edges), *_keys(nodes)]))
    side = nodes.select(*_keys(nodes), F.col("node").alias(b), F.col(x).alias("__x"))
    met = heavy(edges, [*both, b]).join(edges.select(*_keys(edges), "src", "dst", "w"), side).withColumnRenamed(a, "node")
    sums = reduce_vectors(met.select(*keys, "node", vscale(F.col("__x"), F.col("w")).alias("__wx")), [*keys, "node"], "__wx", dim, "sum", out)
    base = nodes.select(*_keys(nodes), "node", *keep)
    if "batch" in keys and "batch" not in base.columns:
        base = base.crossJoin(edges.select("batch").distinct())  # nodes shared by all graphs of a batch: each is a row of the result
    return keep_all(base, sums, [*keys, "node"], {out: zeros(dim)})


def matmul(left: DataFrame, right: DataFrame) -> DataFrame:
    """The product of two sparse matrices (src, dst, w)."""
    r = right.select(F.col("src").alias("__k"), F.col("dst").alias("__j"), F.col("w").alias("__v"))
    met = left.join(r, F.col("dst") == F.col("__k"))
    return met.groupBy("src", F.col("__j").alias("dst")).agg(F.sum(F.col("w") * F.col("__v")).alias("w"))


def unique_inverse(df: DataFrame, column: str, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(value, number) of the distinct values in order, and ``df`` with each row's number.

    With ``order``, a column that orders the rows, values are numbered by their first appearance.
    Ranges of the sorted values are numbered apart and shifted by the rows before, so that no task sorts all; they
    are written, so that the numbers hold.
    """
    values = df.groupBy(F.col(column).alias("value")).agg((F.min(order) if order else F.lit(0)).alias("__first"))
    values = values.repartitionByRange("__first", "value").sortWithinPartitions("__first", "value").drop("__first")
    values = written(values.withColumn("__run", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "unique")
    starts = values.groupBy("__run").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first")).orderBy("__run").collect()  # a row a range
    before, shift = 0, []
    for r in starts:
        shift.append((r["__run"], r["first"] - before))
        before += r["n"]
    table = df.sparkSession.createDataFrame(shift or [(0, 0)], "__run int, __shift long")
    numbered = values.join(F.broadcast(table), "__run").select("value", (F.col("__at") - F.col("__shift")).alias("number"))
    return numbered, df.join(numbered, df[column].eqNullSafe(numbered["value"])).drop("value")
