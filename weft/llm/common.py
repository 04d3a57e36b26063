"""Helpers that the operators of this subpackage share.

* ``durable`` cuts lineage through a Parquet table in the shared checkpoint folder.
* ``map_text`` runs a numpy function over the raw UTF-8 bytes of a text column, Arrow batch by Arrow
  batch, in slices of bounded size, and keeps the other columns as they are.
* ``grouped_rows`` turns a stream of Arrow batches that is sorted by key into whole groups.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one numpy step looks at; a single longer text makes a slice of its own.
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where unset on a local master (tests), a folder of our own."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.weft.scratch", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.weft.scratch", path)
    return path


def durable(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    The table outlives any executor. It is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weft-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(key: str, folds: int):
    """Remainder of the CRC-32 of the key as text: the contract's train and test split."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and len+1 offsets into them. A null text is empty."""
    column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8, hi - lo, lo) if data is not None and hi > lo else np.zeros(0, np.uint8)
    return raw, offsets - lo


def slices(batch: pa.RecordBatch, index: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts stay within ``limit`` bytes (or are one text)."""
    if not len(batch):
        return
    ends = text_bytes(batch.column(index))[1][1:]
    at = 0
    while at < len(batch):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def map_text(
    df: DataFrame,
    text: str,
    keep: list[str],
    make: Callable[[], Callable[[np.ndarray, np.ndarray, pa.RecordBatch], dict]],
    fields: list[T.StructField],
) -> DataFrame:
    """One output row per input row: the columns ``keep`` and those that the numpy function makes.

    ``make`` is called once per task and returns ``fn(raw, offsets, batch) -> {field: values}``.
    """
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*[source.schema[c] for c in keep], *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, len(keep)):
                raw, offsets = text_bytes(part.column(len(keep)))
                made = fn(raw, offsets, part)
                columns = [*part.columns[: len(keep)], *[x if isinstance(x, pa.Array) else pa.array(x) for x in (made[n] for n in names)]]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *names])

    return source.mapInArrow(run, schema)


def expand_text(df: DataFrame, text: str, keep: list[str], make, schema: T.StructType) -> DataFrame:
    """As ``map_text``, with any number of output rows: ``fn(raw, offsets, batch) -> RecordBatch | None``.

    The function may also have an attribute ``flush()`` that returns last rows at the end of a task.
    """
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch, len(keep)):
                made = fn(*text_bytes(part.column(len(keep))), part)
                if made is not None and len(made):
                    yield made
        for made in getattr(fn, "flush", list)():
            yield made

    return source.mapInArrow(run, schema)


def grouped_rows(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Whole groups (equal first ``keys`` columns) of batches sorted by key, several small groups at once.

    Yields record batches that end where a group ends; the caller finds the bounds with ``bounds``.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        cut = bounds(batch, keys)
        if held and _same_key(held[-1], batch, keys):
            if len(cut) == 2:
                held.append(batch)
                continue
            held.append(batch.slice(0, int(cut[1])))
            yield _joined(held)
            held, batch = [], batch.slice(int(cut[1]))
            cut = cut[1:] - cut[1]
        elif held:
            yield _joined(held)
            held = []
        if len(cut) > 2:
            yield batch.slice(0, int(cut[-2]))
        held = [batch.slice(int(cut[-2]))]
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _same_key(a: pa.RecordBatch, b: pa.RecordBatch, keys: int) -> bool:
    return all(a.column(k)[-1].as_py() == b.column(k)[0].as_py() for k in range(keys))


def bounds(batch: pa.RecordBatch, keys: int) -> np.ndarray:
    """Starts of the groups of a batch sorted by its first ``keys`` columns, and its length."""
    new = np.zeros(len(batch), bool)
    new[:1] = True
    for k in range(keys):
        column = batch.column(k)
        if len(column) > 1:
            new[1:] |= pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), len(batch))
