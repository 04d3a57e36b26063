"""Approximate nearest neighbours by inner product, with an adaptive dimension scan.

Vectors are dealt to lists by their nearest coarse centroid and the nearest fine one to what is left of them
(k-means on a bounded sample of ``SAMPLE`` rows; every row is indexed). A list's centre is the sum of both, so that
the number of lists grows with the square root of the rows while two small tables of centroids go to the tasks. Lists
are packed into blocks of bounded size; a large list is dealt in salts, each of which meets all queries of the list. A
query first scans its nearest lists in full, which gives a bound for its k-th best score. In the other
lists that it probes, randomly rotated vectors are compared a block of columns at a time: a hypothesis
test (Gao and Long, ADSampling) on the partial distance abandons a candidate as soon as its distance is
improbably below what the bound asks for. What is left is scored exactly on the original vectors.

How many lists are probed is calibrated: ``CALIBRATION`` queries are compared with all rows, and so many
lists are taken that ``RECALL`` of their true neighbours lie in them.

Defined results: vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part, nor do rows without an id; rows that share an id are rows of their own, each a candidate, also of
a query with that id, and each with neighbours of its own if queries; an empty table or one without queries gives no rows; a
query with fewer candidates than k gets all; other columns are ignored.

Rows are numbered in the order of their ids, and go by these numbers until the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

SAMPLE = 32_768
#: Coarse centroids, and fine ones, at most; lists are pairs of them.
COARSE = 4096
CALIBRATION = 100
RECALL = 0.975
#: Scores of queries with lists that a task looks at together.
SCORES = 1 << 22
#: Lists that a query scans in full before any test.
FIRST_LISTS = 3
BLOCK = 1024
QUERIES = 256
COLUMNS = 16
#: The test abandons a candidate if its scaled partial distance is above (1 + EPSILON / sqrt(columns)) times the bound.
EPSILON = 2.1


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    kind = df.schema[vector].dataType.elementType
    kind = kind if isinstance(kind, T.FloatType) else T.DoubleType()
    rows = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(T.ArrayType(kind)).alias("v")).filter("vec_id is not null and v is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.filter(F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    return rows


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's k-means on the bounded sample."""
    rng = np.random.default_rng(5)
    distinct = np.unique(sample, axis=0)
    c = distinct[rng.choice(len(distinct), min(lists, len(distinct)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(sample, c)
        order = np.argsort(near, kind="stable")
        cut = np.searchsorted(near[order], np.arange(len(c) + 1))
        full = np.flatnonzero(np.diff(cut))
        c[full] = np.add.reduceat(sample[order], cut[full]) / np.diff(cut)[full, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * np.einsum("ij,ij->i", c, c), axis=1)


class Lists:
    """Coarse and fine centroids; list number = coarse number times fine ones plus fine number."""

    def __init__(self, sample: np.ndarray, lists: int, most: int):
        self.coarse = centroids(sample, min(lists, most))
        fine = -(-lists // len(self.coarse)) if lists > most else 1
        rest = sample - self.coarse[nearest(sample, self.coarse)]
        self.fine = centroids(rest, min(fine, most)) if fine > 1 else np.zeros((1, sample.shape[1]))

    def __len__(self) -> int:
        return len(self.coarse) * len(self.fine)

    def of(self, x: np.ndarray) -> np.ndarray:
        first = nearest(x, self.coarse)
        return first * len(self.fine) + nearest(x - self.coarse[first], self.fine)

    def scores(self, q: np.ndarray) -> np.ndarray:
        """Inner products with the centres of all lists."""
        return ((q @ self.coarse.T)[:, :, None] + (q @ self.fine.T)[:, None, :]).reshape(len(q), -1)


def best(scores: np.ndarray, query: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best pairs, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[place < k]


def exact(rows: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int, dim: int) -> DataFrame:
    """(query_id, vec_id, score, v, rank): the true neighbours of a bounded set of queries, against all rows."""
    held = rows.sparkSession.sparkContext.broadcast((queries.astype(float), ids))

    def run(batches):
        q, qids = held.value
        for batch in batches:
            if not len(batch):
                continue
            x, xid = _matrix(batch.column(1), dim).astype(float), batch.column(0).to_numpy()
            s = q @ x.T
            s[qids[:, None] == xid[None]] = -np.inf
            top = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
            who = np.repeat(np.arange(len(q)), top.shape[1])
            top, score = top.ravel(), np.take_along_axis(s, top, 1).ravel()
            real = score > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(qids[who[real]]), pa.array(xid[top[real]]), pa.array(score[real]), batch.column(1).take(pa.array(top[real]))], names=["query_id", "vec_id", "score", "v"])

    found = rows.mapInArrow(run, T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType()), rows.schema["v"]]))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def packed(rows: DataFrame, dim: int, extra: bool) -> DataFrame:
    """(list, salt, ids, vectors, bounds): the rows of each list and salt in blocks of bounded size; columns list, salt, vec_id, v (and bound) come in."""
    size = QUERIES if extra else BLOCK

    def run(batches):
        held, count = [], 0
        for batch in batches:
            held.append(batch)
            count += len(batch)
            if count >= 64 * size:
                ready = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                last = np.flatnonzero(np.diff(ready.column(0).to_numpy()) | np.diff(ready.column(1).to_numpy()))
                cut = int(last[-1]) + 1 if len(last) else len(ready) // size * size
                yield blocks(ready.slice(0, cut))
                held, count = [ready.slice(cut)], len(ready) - cut
        if count:
            yield blocks(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def blocks(batch):
        lists, salts, ids = (batch.column(i).to_numpy() for i in range(3))
        x = _matrix(batch.column(3), dim)
        bound = batch.column(4).to_numpy() if extra else None
        cut = [0]
        for end in np.append(np.flatnonzero(np.diff(lists) | np.diff(salts)) + 1, len(lists)).tolist():
            while end - cut[-1] > size:
                cut.append(cut[-1] + size)
            cut.append(end)
        pairs = list(zip(cut[:-1], cut[1:], strict=True))
        columns = [pa.array([int(of[a]) for a, _ in pairs], pa.int32()) for of in (lists, salts)]
        columns += [pa.array([ids[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([np.ascontiguousarray(x[a:b]).tobytes() for a, b in pairs], pa.binary())]
        names = ["list", "salt", "ids", "vectors"]
        if extra:
            columns.append(pa.array([bound[a:b].tobytes() for a, b in pairs], pa.binary()))
            names.append("bounds")
        return pa.RecordBatch.from_arrays(columns, names=names)

    kinds = "list int, salt int, ids binary, vectors binary" + ", bounds binary" * extra
    rows = rows.select("list", F.col("salt").cast("int").alias("salt"), "vec_id", "v", *["bound"] * extra)
    return rows.repartition("list", "salt").sortWithinPartitions("list", "salt").mapInArrow(run, kinds)


def scan(queries: DataFrame, items: DataFrame, salts: DataFrame, dim: int, single: bool, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the candidates that are left of each pair of a query block and an item block.

    ``salts`` (list, salts): a query block goes to each salt of its list, so that a large list is many tasks.
    """
    turn = rotation(dim)
    kind = np.float32 if single else np.float64

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                qid, q, bound, xid, x = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in enumerate((np.int64, kind, np.float64, np.int64, kind)))
                q, x = q.reshape(-1, dim).astype(float), x.reshape(-1, dim).astype(float)
                a, b = survivors(q @ turn, x @ turn, bound)
                own = qid[a] != xid[b]
                a, b = a[own], b[own]
                score = np.einsum("ij,ij->i", q[a], x[b])
                keep = score >= bound[a]
                a, b, score = a[keep], b[keep], score[keep]
                top = best(score, a, xid[b], k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[a[top]]), pa.array(xid[b[top]]), pa.array(score[top])], names=["query_id", "vec_id", "score"])

    asked = queries.select("list", F.col("ids").alias("qids"), F.col("vectors").alias("q"), "bounds").join(salts, "list")
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    met = asked.join(items, ["list", "salt"])
    return met.select("qids", "q", "bounds", "ids", "vectors").mapInArrow(run, "query_id long, vec_id long, score double")


def survivors(q: np.ndarray, x: np.ndarray, bound: np.ndarray, epsilon: float = EPSILON, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no test abandons: column blocks of rotated vectors, partial against permitted squared distances."""
    dim = q.shape[1]
    qq, xx = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", x, x)
    open_ = ~np.isfinite(bound)
    limit = np.where(open_, 0.0, bound)
    most = qq[:, None] + xx[None] - 2 * limit[:, None]
    slack = 1e-9 * (qq[:, None] + xx[None])
    first = min(columns, dim)
    part = ((q[:, :first] ** 2).sum(1)[:, None] + (x[:, :first] ** 2).sum(1)[None]) - 2 * q[:, :first] @ x[:, :first].T
    factor = (1 + epsilon / first**0.5) ** 2 if first < dim else 1.0
    a, b = np.nonzero(open_[:, None] | ((part * (dim / first) <= factor * most + slack) & (most >= -slack)))
    part, most, slack = part[a, b], most[a, b], slack[a, b]
    for lo in range(first, dim, columns):
        hi = min(lo + columns, dim)
        d = q[a, lo:hi] - x[b, lo:hi]
        part = part + np.einsum("ij,ij->i", d, d)
        factor = (1 + epsilon / hi**0.5) ** 2 if hi < dim else 1.0
        keep = open_[a] | (part * (dim / hi) <= factor * most + slack)
        a, b, part, most, slack = a[keep], b[keep], part[keep], most[keep], slack[keep]
    return a, b


def _probes(rows: DataFrame, c: Lists, sizes: np.ndarray, probes: int, k: int, dim: int, first: bool) -> DataFrame:
    """(list, vec_id, v, bound): a row for each list that a query scans first, or afterwards."""
    held = rows.sparkSession.sparkContext.broadcast((c, sizes))

    def run(batches):
        c, sizes = held.value
        step = max(1, SCORES // len(c))
        for whole in batches:
            for lo in range(0, len(whole), step):
                batch = whole.slice(lo, step)
                order = np.argsort(-c.scores(_matrix(batch.column(1), dim).astype(float)), axis=1, kind="stable")
                many = np.cumsum(sizes[order], axis=1) > k  # so many lists that there are k besides the query itself
                least = np.where(many[:, -1], many.argmax(axis=1) + 1, len(c))
                start = np.maximum(least, min(FIRST_LISTS, len(c)))
                stop = np.maximum(start, probes)
                rank = np.arange(len(c))[None]
                use = rank < start[:, None] if first else (rank >= start[:, None]) & (rank < stop[:, None])
                at, place = np.nonzero(use)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(order[at, place].astype(np.int32)), *[batch.column(i).take(take) for i in range(3)]], names=["list", "vec_id", "v", "bound"])

    return rows.mapInArrow(run, T.StructType([T.StructField("list", T.IntegerType()), *rows.schema.fields]))


def search(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, coarse: int = COARSE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is divisible by ``every``."""
    spark = df.sparkSession
    rows = usable(df, key, vector)
    widths = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    dim = widths["w"] if widths else 1
    order = ["vec_id", F.xxhash64("v")]
    rows = rows.filter(F.size("v") == dim).repartitionByRange(*order).sortWithinPartitions(*order)
    named = durable(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"), "vectors")  # numbers hold once they are written
    rows = named.select(F.col("row").alias("vec_id"), "v")
    single = isinstance(rows.schema["v"].dataType.elementType, T.FloatType)
    n = widths["n"] if widths else 0
    lists = max(1, round(n**0.5 / 2))
    share = min(1.0, min(SAMPLE, 128 * lists) / max(n, 1))
    picked = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).limit(SAMPLE).toArrow()  # SAMPLE rows
    sample = _matrix(picked.column("v").combine_chunks(), dim).astype(float) if len(picked) else np.zeros((1, dim))
    c = Lists(sample, lists, coarse)
    center = spark.sparkContext.broadcast(c)

    def assign(batches):
        for batch in batches:
            if len(batch):
                near = center.value.of(_matrix(batch.column(1), dim).astype(float))
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *batch.columns], names=["list", "vec_id", "v"])

    placed = rows.mapInArrow(assign, T.StructType([T.StructField("list", T.IntegerType()), *rows.schema.fields]))
    placed = durable(placed, "placed")
    counts = durable(placed.groupBy("list").agg(F.count(F.lit(1)).alias("n")), "counts")
    sizes = np.zeros(len(c), np.int64)
    for r in counts.collect():  # a row a list: the square root of the rows
        sizes[r["list"]] = r["n"]
    salts = counts.select("list", F.ceil(F.col("n") / (4 * BLOCK)).cast("int").alias("salts"))
    items = placed.join(salts, "list").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")))
    items = durable(packed(items, dim, False), "items")
    asked = named.filter(F.col("vec_id") % every == 0).select(F.col("row").alias("vec_id"), "v")
    probes = _calibrated(rows, asked, c, dim, k)
    salted = lambda x: x.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, int(n // every // QUERIES)))))
    start = _probes(asked.withColumn("bound", F.lit(float("-inf"))), c, sizes, probes, k, dim, True)
    near = durable(scan(packed(salted(start), dim, True), items, salts, dim, single, k), "near")
    worst = _top(near, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    worst = worst.select(F.col("query_id").alias("vec_id"), F.when(F.col("n") >= k, F.col("worst")).otherwise(float("-inf")).alias("bound"))
    rest = _probes(asked.join(worst, "vec_id", "left").fillna(float("-inf"), ["bound"]).select("vec_id", "v", "bound"), c, sizes, probes, k, dim, False)
    far = scan(packed(salted(rest), dim, True), items, salts, dim, single, k)
    found = _top(near.union(far), k)
    query, candidate = named.select(F.col("row").alias("query_id"), F.col("vec_id").alias("__query")), named.select(F.col("row").alias("vec_id"), F.col("vec_id").alias("__vec"))
    found = found.join(query, "query_id").join(candidate, "vec_id")
    return found.select(F.col("__query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("__vec").alias("vec_id"), "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    found = found.dropDuplicates(["query_id", "vec_id"])
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)


def _calibrated(rows: DataFrame, asked: DataFrame, c: Lists, dim: int, k: int) -> int:
    """How many of a query's lists hold RECALL of the true neighbours of CALIBRATION queries."""
    some = asked.orderBy(F.xxhash64("vec_id")).limit(CALIBRATION).toArrow()
    if not len(some):
        return len(c)
    q, ids = _matrix(some.column("v").combine_chunks(), dim).astype(float), some.column("vec_id").to_numpy()
    true = exact(rows, q, ids, k, dim).select("query_id", "v").toArrow()  # CALIBRATION * k rows
    if not len(true):
        return len(c)
    order = np.argsort(-c.scores(q), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(c))[None].repeat(len(q), 0), 1)
    at = {int(x): i for i, x in enumerate(ids)}
    near = c.of(_matrix(true.column("v").combine_chunks(), dim).astype(float))
    ranks = rank[[at[x] for x in true.column("query_id").to_pylist()], near]
    return int(np.quantile(ranks, RECALL, method="higher")) + 1
