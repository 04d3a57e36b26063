"""Aggregates that a user writes for data, segment numbers and a count of segments, run as partial states in tasks.

A task reduces the rows that it reads to one state for each segment it meets; states travel, sorted by segment, and are
merged as a stream. So a segment may be spread over any number of tasks, and none holds its rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: States that a task holds before it merges them, and sends them on if that doesn't halve them.
HELD = 1 << 16


class SegmentAggregate:
    """Base of user aggregates: numpy functions over (data, segment numbers 0 to count - 1, count).

    ``start``: rows of data to a state of fixed width for each segment; ``merge``: several states of a segment to one (their
    sum, unless overridden); ``finish``: states to results. Every segment of a call has a row at least. Merging must not depend on order but
    for rounding.
    """

    def start(self, data: np.ndarray, index: np.ndarray, count: int) -> np.ndarray:
        raise NotImplementedError

    def merge(self, states: np.ndarray, index: np.ndarray, count: int) -> np.ndarray:
        return segment_sum(states, index, count)

    def finish(self, states: np.ndarray) -> np.ndarray:
        return states

    def width(self, dim: int) -> int:
        """The width of a result for data of width ``dim``."""
        return dim


def segment_sum(data: np.ndarray, index: np.ndarray, count: int) -> np.ndarray:
    """Sums of rows by segment; the segments may stand in any order."""
    order = np.argsort(index, kind="stable")
    own = index[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, int)
    out = np.zeros((count, data.shape[1]))
    if len(own):
        out[own[first]] = np.add.reduceat(data[order], first, axis=0)
    return out


def _numbered(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """(segment number of each row, first row of each segment) of rows with these keys."""
    codes = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        d = c.dictionary_encode()
        own = d.indices.fill_null(len(d.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        codes = np.unique(codes * (len(d.dictionary) + 1) + own, return_inverse=True)[1]
    _, first, index = np.unique(codes, return_index=True, return_inverse=True)
    return index, first


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _rows(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def aggregate(df: DataFrame, keys: list[str], vector: str, how: SegmentAggregate, out: str = "h") -> DataFrame:
    """(keys, out) of each group of rows. Rows whose vector is null don't count; groups without others have no row."""
    source = df.select(*keys, F.col(vector).cast("array<double>").alias("__x")).filter("__x is not null")
    width = len(keys)
    fields = [source.schema[k] for k in keys]
    names = [*keys, "__s"]
    states = T.StructType([*fields, T.StructField("__s", T.ArrayType(T.DoubleType()))])

    def merged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        index, first = _numbered(whole.columns[:width])
        at = pa.array(first)
        return pa.RecordBatch.from_arrays([*[c.take(at) for c in whole.columns[:width]], _rows(how.merge(_vectors(whole.column(width)), index, len(first)))], names=names)

    def partial(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in batches:
            if not len(batch):
                continue
            index, first = _numbered(batch.columns[:width])
            at = pa.array(first)
            held.append(pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[:width]], _rows(how.start(_vectors(batch.column(width)), index, len(first)))], names=names))
            size += len(first)
            if size > HELD:
                held = [merged(held)]
                size = len(held[0])
                if size > HELD // 2:
                    yield held.pop()
                    size = 0
        if held:
            yield merged(held)

    def final(batches: Iterator[pa.RecordBatch]):
        last = None
        for batch in batches:
            if not len(batch):
                continue
            whole = pa.Table.from_batches([last, batch] if last else [batch]).combine_chunks().to_batches()[0]
            index, _ = _numbered(whole.columns[:width])
            # rows are sorted by key, so that only the last group may go on
            cut = int(np.flatnonzero(index == index[-1])[0])
            if cut:
                yield done(merged([whole.slice(0, cut)]))
            last = merged([whole.slice(cut)])
        if last:
            yield done(last)

    def done(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:width], _rows(how.finish(_vectors(batch.column(width))))], names=[*keys, out])

    parts = source.mapInArrow(partial, states).repartition(*keys).sortWithinPartitions(*keys)
    return parts.mapInArrow(final, T.StructType([*fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


class Variance(SegmentAggregate):
    """Population variance of each place. A state is the rows' number, their means, and the sums of squares around them."""

    def start(self, data, index, count):
        n = np.bincount(index, minlength=count)[:, None]
        mean = segment_sum(data, index, count) / n
        return np.concatenate([n, mean, segment_sum((data - mean[index]) ** 2, index, count)], axis=1)

    def merge(self, states, index, count):
        dim = (states.shape[1] - 1) // 2
        n, mean, square = states[:, :1], states[:, 1 : dim + 1], states[:, dim + 1 :]
        whole = segment_sum(n, index, count)
        middle = segment_sum(n * mean, index, count) / whole
        return np.concatenate([whole, middle, segment_sum(square + n * (mean - middle[index]) ** 2, index, count)], axis=1)

    def finish(self, states):
        dim = (states.shape[1] - 1) // 2
        return states[:, dim + 1 :] / states[:, :1]


class LogSumExp(SegmentAggregate):
    """log of the sum of exp of each place, shifted by the largest value met."""

    def start(self, data, index, count):
        top = np.full((count, data.shape[1]), -math.inf)
        np.maximum.at(top, index, data)
        shift = np.where(np.isfinite(top), top, 0.0)
        return np.concatenate([top, segment_sum(np.exp(data - shift[index]), index, count)], axis=1)

    def merge(self, states, index, count):
        dim = states.shape[1] // 2
        top = np.full((count, dim), -math.inf)
        np.maximum.at(top, index, states[:, :dim])
        shift = np.where(np.isfinite(top), top, 0.0)
        own = np.where(np.isfinite(states[:, :dim]), states[:, :dim], 0.0)
        return np.concatenate([top, segment_sum(states[:, dim:] * np.exp(own - shift[index]), index, count)], axis=1)

    def finish(self, states):
        dim = states.shape[1] // 2
        with np.errstate(divide="ignore"):
            return np.where(np.isfinite(states[:, :dim]), states[:, :dim], 0.0) + np.log(states[:, dim:])
