"""Grouped reductions of vectors: one aggregate a column, in chunks that generated code can hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.sources.balance import heavy

from .mergeable import SegmentAggregate, aggregate
from .vectors import LOWEST, SOFTMAX_EPSILON

CHUNK = 64
#: Binary places of the parts in which ``exact_sum`` takes a double, and what lies above them.
PARTS, ABOVE = (10, 42, 74), 2.0**21


def exact_sum(v: Column) -> Column:
    """The sum of doubles to their last place, the same in whatever order and tasks rows come.

    A double is cut at binary places into whole numbers of 32 bits (what is below 2^-75 is rounded off), whose sums are exact up to four billion rows.
    A group with a value from 2^21 on, or one that isn't finite, gets the plain sum.
    """
    within = F.abs(v) < ABOVE
    rest, sums = F.when(within, v), []
    for places in PARTS:
        part = F.rint(rest * 2.0**places)
        sums.append(F.sum(part.cast("long")).cast("double") / 2.0**places)
        rest = rest - part / 2.0**places
    high, middle, low = sums
    return F.when(F.bool_and(within), high + (middle + low)).otherwise(F.sum(v))


def exact_mean(v: Column) -> Column:
    return exact_sum(v) / F.count(v)


#: The reductions that have a name; a function from column to aggregate column, or a ``SegmentAggregate``, is taken as well.
REDUCERS: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "max": F.max, "exact_sum": exact_sum}
FILLS: dict[str, float | None] = {"sum": 0.0, "max": LOWEST, "exact_sum": 0.0}


def register_reducer(name: str, how, fill: float | None = 0.0) -> None:
    """Give a reduction a name, by which layers take it and their configurations keep it."""
    if not (callable(how) or isinstance(how, SegmentAggregate)):
        raise ValueError("a reduction is a function from column to aggregate column, or a SegmentAggregate")
    REDUCERS[name], FILLS[name] = how, fill


def reducer(name) -> Callable[[Column], Column] | SegmentAggregate:
    if callable(name) or isinstance(name, SegmentAggregate):
        return name
    if name not in REDUCERS:
        raise ValueError(f"unknown aggregation {name!r}; known: {', '.join(REDUCERS)}")
    return REDUCERS[name]


def reducer_name(f) -> str:
    for name, own in REDUCERS.items():
        if f in (name, own):
            return name
    return getattr(f, "__name__", type(f).__name__ if isinstance(f, SegmentAggregate) else str(f))


def reduced_dim(how, dim: int) -> int:
    """The width of what a reduction gives for vectors of width ``dim``."""
    how = reducer(how)
    return how.width(dim) if isinstance(how, SegmentAggregate) else dim


def reduce_vectors(df: DataFrame, keys: list[str], vector: str | Column, dim: int, how="sum", out: str = "h", extra: list[Column] = ()) -> DataFrame:
    """(keys, out, extra aggregates): the vectors of each group reduced place by place.

    Beyond CHUNK places a row is cut into pieces that are groups of their own, so that ``df`` is computed once; the
    pieces of a group, already reduced, are put together again.
    """
    f = reducer(how)
    if isinstance(f, SegmentAggregate):
        if extra:
            raise ValueError("a SegmentAggregate takes no further aggregates")
        return aggregate(df.withColumn("__v", F.col(vector) if isinstance(vector, str) else vector), keys, "__v", f, out)
    v = F.col(vector) if isinstance(vector, str) else vector
    rows = df.withColumn("__v", v)
    if dim <= CHUNK:
        return rows.groupBy(*keys).agg(F.array(*[f(F.get("__v", F.lit(i))) for i in range(dim)]).alias(out), *extra)
    pieces = -(-dim // CHUNK)
    rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))
    rows = rows.withColumn("__v", F.slice("__v", F.col("__k") * CHUNK + 1, CHUNK))
    parts = rows.groupBy(*keys, "__k").agg(F.array(*[f(F.get("__v", F.lit(i))) for i in range(CHUNK)]).alias("__c"), *extra)
    names = [c for c in parts.columns if c not in (*keys, "__k", "__c")]
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__k", "__c"))), lambda s: s["__c"]))  # the pieces of one vector
    return parts.groupBy(*keys).agg(F.slice(whole, 1, dim).alias(out), *[F.max(F.when(F.col("__k") == 0, F.col(c))).alias(c) for c in names])


def keep_all(nodes: DataFrame, found: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """Rows of ``nodes`` with the columns of ``found``, filled where a key has none."""
    joined = nodes.join(found, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), fill) for c, fill in columns.items()})


def all_segments(found: DataFrame, index: str) -> DataFrame:
    """(index) of every segment from 0 to the largest one present."""
    top = found.agg(F.max(index).alias("top"))
    return top.filter("top is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"))).alias(index))


def segment_softmax(df: DataFrame, keys: list[str], logit: str, out: str = "alpha") -> DataFrame:
    """``df`` with exp(v - max) / (sum exp(v - max) + 1e-9) within each segment.

    Maxima and sums are pre-aggregated and joined back, so that one large segment isn't one task's window; rows are counted by
    segment (a job), and those of a large segment meet its maximum and its sum in several tasks.
    """
    many = heavy(df, keys)
    top = df.groupBy(*keys).agg(F.max(logit).alias("__top"))
    rows = many.join(df, top).withColumn("__e", F.exp(F.col(logit) - F.col("__top"))).drop("__top")
    sums = rows.groupBy(*keys).agg(F.sum("__e").alias("__sum"))
    rows = many.join(rows, sums).withColumn(out, F.col("__e") / (F.col("__sum") + F.lit(SOFTMAX_EPSILON)))
    return rows.drop("__e", "__sum")
