"""Segment aggregators: rows (index, x) become one row for each segment.

``sum`` and ``max`` give every segment up to the largest index, gaps filled with 0 or the lowest number;
means give only segments that have rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.mergeable import SegmentAggregate
from weft.functions.segments import all_segments, keep_all, reduce_vectors, reduced_dim, reducer
from weft.functions.vectors import LOWEST, clip


def assert_sorted_index(df: DataFrame, index: str = "index") -> None:
    """Raise if a row's index is below that of the row before it, in the order in which the table is read.

    A task looks at its own rows and gives its first and last index; the driver compares neighbours, a row a partition.
    Indexes are numbers; null ones are passed over.
    """

    def run(batches):
        first = last = None
        even = True
        for batch in batches:
            x = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            if len(x):
                even &= bool((x[1:] >= x[:-1]).all()) and (last is None or x[0] >= last)
                first, last = x[0] if first is None else first, x[-1]
        if first is not None:
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], kind), pa.array([last], kind), pa.array([even])], names=["part", "first", "last", "even"])

    kind = df.schema[index].dataType.simpleString()
    parts = sorted(df.select(index).mapInArrow(run, f"part int, first {kind}, last {kind}, even boolean").collect())
    if not all(p["even"] for p in parts) or any(a["last"] > b["first"] for a, b in zip(parts[:-1], parts[1:], strict=True)):
        raise ValueError(f"the column {index!r} is not sorted")


def index_of_ptr(rows: DataFrame, ptr: list[int], position: str = "row", index: str = "index") -> DataFrame:
    """``rows`` with the index of the segment that each position falls into: segment i has the positions ptr[i] to ptr[i + 1] - 1."""
    if list(ptr) != sorted(ptr) or not ptr or ptr[0] != 0:
        raise ValueError("ptr starts with 0 and doesn't fall")
    bounds = rows.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(ptr[:-1], ptr[1:], strict=True)) if b > a], f"{index} long, __from long, __to long")
    return rows.join(F.broadcast(bounds), (F.col(position) >= F.col("__from")) & (F.col(position) < F.col("__to"))).drop("__from", "__to")  # a row a segment that the caller named


class Aggregation:
    """Base: ``reduce`` with any function from column to aggregate column, or a ``SegmentAggregate``; ``fill`` for gaps, None
    to leave them out.

    ``dim_size`` says how many segments there are, instead of the largest index plus 1; an index beyond it raises when the
    result is read. ``check_sorted`` raises unless the index rises in the order of the rows (a job).
    """

    how: str | Callable[[Column], Column] | SegmentAggregate = "sum"
    fill: float | None = 0.0

    def reduce(self, df: DataFrame, dim: int, index: str = "index", x: str = "x", how=None, fill: float | None = None, dim_size: int | None = None, check_sorted: bool = False) -> DataFrame:
        for c in (index, x):
            if c not in df.columns:
                raise ValueError(f"no column {c!r}")
        if check_sorted:
            assert_sorted_index(df, index)
        rows = df.filter(F.col(index).isNotNull())
        if dim_size is not None:
            beyond = F.raise_error(F.concat(F.lit(f"dim_size is {dim_size}, but an index is "), F.col(index).cast("string"))).cast(df.schema[index].dataType)
            rows = rows.withColumn(index, F.when((F.col(index) >= 0) & (F.col(index) < dim_size), F.col(index)).otherwise(beyond))
        how = how or self.how
        found = reduce_vectors(rows, [index], x, dim, how, "h")
        if fill is None:
            return found
        every = all_segments(found, index) if dim_size is None else df.sparkSession.range(dim_size).select(F.col("id").alias(index))
        return keep_all(every, found, [index], {"h": F.array_repeat(F.lit(float(fill)), reduced_dim(how, dim))})

    def __call__(self, df: DataFrame, dim: int, index: str = "index", x: str = "x", dim_size: int | None = None, check_sorted: bool = False) -> DataFrame:
        return self.reduce(df, dim, index, x, fill=self.fill, dim_size=dim_size, check_sorted=check_sorted)


class UserAggregation(Aggregation):
    """Any reduction as an aggregator: a name, a function from column to aggregate column, or a ``SegmentAggregate``."""

    def __init__(self, how, fill: float | None = None):
        self.how, self.fill = reducer(how), fill


class SumAggregation(Aggregation):
    pass


class MaxAggregation(Aggregation):
    how = "max"

    def __init__(self, fill: float | None = LOWEST):
        self.fill = fill


class MeanAggregation(Aggregation):
    how = staticmethod(F.avg)
    fill = None


class SoftmaxAggregation(Aggregation):
    """Sums of x weighted by the softmax of t x over all rows, column by column.

    A trainable t starts from zero, whatever ``t`` says; more than one channel needs a trainable t.
    """

    def __init__(self, t: float = 1.0, trainable: bool = False, channels: int = 1, weights=None):
        if channels != 1 and not trainable:
            raise ValueError("channels > 1 needs a trainable t")
        self.t = [float(v) for v in weights] if weights is not None else [0.0] * channels if trainable else [float(t)]

    def __call__(self, df, dim, index="index", x="x"):
        t = self.t * dim if len(self.t) == 1 else self.t
        places = range(dim)
        scaled = [F.get(x, F.lit(i)) * F.lit(t[i]) for i in places]
        top = df.agg(*[F.max(s).alias(f"m{i}") for i, s in enumerate(scaled)])
        rows = df.crossJoin(F.broadcast(top))  # one row
        e = F.array(*[F.exp(s - F.col(f"m{i}")) for i, s in enumerate(scaled)])
        rows = rows.select(index, x, e.alias("__e"))
        sums = rows.agg(*[F.sum(F.get("__e", F.lit(i))).alias(f"s{i}") for i in places])
        rows = rows.crossJoin(F.broadcast(sums))
        weighted = F.array(*[F.get(x, F.lit(i)) * F.get("__e", F.lit(i)) / F.col(f"s{i}") for i in places])
        return self.reduce(rows.select(index, weighted.alias(x)), dim, index, x, "sum", 0.0)


class PowerMeanAggregation(Aggregation):
    """Mean of powers: x clipped to [0, 100] and raised to p, averaged, clipped again, and the root taken.

    The second clip acts on the mean of powers. With p = 1 it's the plain mean, unclipped. A trainable p
    starts from zero, which gives ones.
    """

    def __init__(self, p: float = 1.0, trainable: bool = False, channels: int = 1, weights=None):
        if channels != 1 and not trainable:
            raise ValueError("channels > 1 needs a trainable p")
        self.plain = not trainable and p == 1
        self.p = [float(v) for v in weights] if weights is not None else [0.0] * channels if trainable else [float(p)]

    def __call__(self, df, dim, index="index", x="x"):
        if self.plain:
            return self.reduce(df, dim, index, x, F.avg)
        p = self.p * dim if len(self.p) == 1 else self.p
        at = lambda c, i: clip(F.get(c, F.lit(i)), 0, 100)
        rows = df.select(index, F.array(*[F.pow(at(x, i), F.lit(p[i])) for i in range(dim)]).alias(x))
        means = self.reduce(rows, dim, index, x, F.avg)
        root = [F.lit(1.0) if p[i] == 0 else F.pow(at("h", i), F.lit(1.0 / p[i])) for i in range(dim)]
        return means.select(index, F.array(*root).alias("h"))


class DeepSetsAggregation(Aggregation):
    """global_mlp(sum over the segment of local_mlp(x)); both are functions from array column to array column."""

    def __init__(self, local_mlp=None, global_mlp=None, local_dim: int | None = None):
        self.local_mlp, self.global_mlp, self.local_dim = local_mlp, global_mlp, local_dim

    def __call__(self, df, dim, index="index", x="x"):
        rows = df if self.local_mlp is None else df.select(index, self.local_mlp(F.col(x)).alias(x))
        sums = self.reduce(rows, self.local_dim or dim, index, x, "sum", 0.0)
        return sums if self.global_mlp is None else sums.withColumn("h", self.global_mlp(F.col("h")))
