"""Products of two dense matrices that are both tables, as blocks on a grid.

A matrix is a table (row, x), x an array. The result's rows are dealt to ``p`` bands, its columns to ``q``, and the places that are
summed over to ``r`` chunks; blocks of the left side are repeated for each band of columns, those of the right for each band
of rows. A cell of the grid multiplies its blocks as matrices, and the partial sums of the chunks are added by Spark. Bands
and chunks come from the tables' sizes, so that a cell holds about ``ROWS`` rows of ``COLUMNS`` places of each side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.segments import reduce_vectors

ROWS = 4096
COLUMNS = 1024
_CELL = ["__p", "__q", "__r"]
_OUT = T.StructType([T.StructField("row", T.LongType()), T.StructField("__q", T.IntegerType()), T.StructField("v", T.ArrayType(T.DoubleType()))])


def _parts(width: int, size: int) -> int:
    return max(1, -(-width // size))


def _band(column: str, bands: int):
    return F.pmod(F.xxhash64(column), F.lit(bands)).cast("int")


def _copies(n: int):
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _cut(x: str, part: str, size: int):
    return F.slice(x, F.col(part) * size + 1, size)


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    cells = table.column(column).combine_chunks()
    return cells.flatten().to_numpy(zero_copy_only=False).reshape(len(cells), -1)


def _keys(table: pa.Table, column: str = "row") -> np.ndarray:
    return table.column(column).to_numpy()


def _made(rows: np.ndarray, q: int, v: np.ndarray) -> pa.Table:
    places = pa.array(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32))
    return pa.table([pa.array(rows, pa.int64()), pa.array(np.full(len(rows), q), pa.int32()), pa.ListArray.from_arrays(places, pa.array(np.ascontiguousarray(v).ravel()))], names=["row", "__q", "v"])


def _none() -> pa.Table:
    return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.list_(pa.float64()))], names=["row", "__q", "v"])


def _together(found: DataFrame, outer: int, size: int, chunks: int, out: str) -> DataFrame:
    """Sums of the chunks' parts, and the bands of columns side by side."""
    bands = _parts(outer, size)
    if chunks > 1:
        found = reduce_vectors(found, ["row", "__q"], "v", min(size, outer), "sum", "v")
    if bands == 1:
        return found.select("row", F.col("v").alias(out))
    whole = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("__q", "v"))).alias("parts"))  # a row's bands
    return whole.select("row", F.slice(F.flatten(F.transform("parts", lambda p: p["v"])), 1, outer).alias(out))


def _padded(v: np.ndarray, outer: int, size: int) -> np.ndarray:
    """Blocks of the last band as wide as the others, so that sums line up."""
    return np.pad(v, ((0, 0), (0, min(size, outer) - v.shape[1]))) if v.shape[1] < min(size, outer) else v


def product(left: DataFrame, right: DataFrame, inner: int, outer: int, out: str = "h", rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """(row, out) of left times right: left is (row, x of width ``inner``), right (row from 0 to inner - 1, x of width ``outer``).

    A row that right lacks counts as zeros. Left is counted first (a job).
    """
    p, q, r = _parts(left.count(), rows), _parts(outer, columns), _parts(inner, columns)
    a = left.select("row", "x", _band("row", p).alias("__p"), _copies(r).alias("__r"))
    a = a.select("row", "__p", "__r", _cut("x", "__r", columns).alias("x"), _copies(q).alias("__q"))
    b = right.select(F.col("row").alias("k"), F.col("x").alias("y"), F.floor(F.col("row") / columns).cast("int").alias("__r"), _copies(q).alias("__q"))
    b = b.select("k", "__q", "__r", _cut("y", "__q", columns).alias("y"), _copies(p).alias("__p"))

    def cell(key, x: pa.Table, y: pa.Table) -> pa.Table:
        if not len(x):
            return _none()
        at, m = key[2].as_py() * columns, _matrix(x, "x")
        width = min(columns, outer - key[1].as_py() * columns)
        other = np.zeros((m.shape[1], width))
        if len(y):
            other[_keys(y, "k") - at] = _matrix(y, "y")
        return _made(_keys(x), key[1].as_py(), _padded(m @ other, outer, columns))

    met = a.groupBy(*_CELL).cogroup(b.groupBy(*_CELL)).applyInArrow(cell, _OUT)
    return _together(met, outer, columns, r, out)


def cross_product(left: DataFrame, right: DataFrame, inner: int, outer: int, out: str = "h", rows: int = ROWS, columns: int = COLUMNS) -> DataFrame:
    """(row from 0 to inner - 1, out) of left' times right: the sum over their common rows; widths ``inner`` and ``outer``.

    Rows that only one side has count as zeros; a row number stands once on each side. Left is counted first (a job).
    """
    r, p, q = _parts(left.count(), rows), _parts(inner, columns), _parts(outer, columns)
    a = left.select("row", "x", _band("row", r).alias("__r"), _copies(p).alias("__p"))
    a = a.select("row", "__p", "__r", _cut("x", "__p", columns).alias("x"), _copies(q).alias("__q"))
    b = right.select(F.col("row").alias("k"), F.col("x").alias("y"), _band("row", r).alias("__r"), _copies(q).alias("__q"))
    b = b.select("k", "__q", "__r", _cut("y", "__q", columns).alias("y"), _copies(p).alias("__p"))

    def cell(key, x: pa.Table, y: pa.Table) -> pa.Table:
        first, q = key[0].as_py() * columns, key[1].as_py()
        places = np.arange(first, min(first + columns, inner))
        width = min(columns, outer - q * columns)
        v = np.zeros((len(places), width))
        if len(x) and len(y):
            _, i, j = np.intersect1d(_keys(x), _keys(y, "k"), return_indices=True)
            v = _matrix(x, "x")[i].T @ _matrix(y, "y")[j]
        return _made(places, q, _padded(v, outer, columns))

    met = a.groupBy(*_CELL).cogroup(b.groupBy(*_CELL)).applyInArrow(cell, _OUT)
    return _together(met, outer, columns, 2, out)
