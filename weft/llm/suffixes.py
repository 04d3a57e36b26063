"""Removal of repeated passages with a distributed difference-cover suffix sort.

Every byte is removed that a ``length``-byte string covers which also starts anywhere else.

1. Anchors. The place with the smallest hash of ``GRAM`` bytes among the first ``WINDOW`` of a string of ``length`` bytes
   is its anchor, so that equal strings have equal anchors. It is followed by ``length - WINDOW + 1`` of the string's bytes (the tail). An anchor whose tail occurs
   once can't lie at the start of a repeated string and is let go: this loses nothing.
2. Contexts. Anchors with equal bytes in all the strings that they answer for start equal strings
   throughout: these strings are repeated, and one context of each kind stands for all. Where a tail
   has one kind of context only, nothing is left to find. Bands of positions within
   the other contexts (``BANDS``) are treated likewise: by the bytes that all their strings share, and by all their bytes.
3. The suffix sort runs on the positions that are left. It follows the
   difference-cover algorithm on blocks of ``length / 8`` bytes: positions whose block number isn't divisible by
   three are the sample; their triples of blocks are sorted and named by rank; the names make the string
   of the recursion, whose sorted triples (two names and the last two blocks) already reach ``length``
   bytes, so that it ends there. The other positions are merged through the names of the sample: a
   position and one of block class 1 are compared one block on, with class 2 two blocks on, where both
   stand on the sample. Neighbours in each order that agree on all ``length`` bytes are repeated strings.
4. The repeated strings of each text are joined to runs, and the runs are cut out.

Sorts are dealt by ranges of key and position, so that many equal keys are spread over tasks; runs that
cross a bound are found from the first and last keys of the ranges (a row a range on the driver).

Equal contexts are told by two 64-bit names of all their bytes, from sums over single bytes and over mixed eights of bytes, so that
neither says anything of the other, and texts by their MD5; in the sort, strings by the names of eight blocks. By far the most repeats are found by the grouping of steps 1 and 2: the sort
decides on what these leave open.

Defined results: a null text is empty; texts of any length are looked at whole; texts shorter than ``length`` lose nothing; repeated rows are repeats of
each other and all lose their text; empty tables give empty tables; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, expand_text, map_text
from .words import EIGHT, mix, mixed_sums, prefix_sums, span_names

LENGTH = 400
WINDOW = 128
GRAM = 16
BLOCKS = 8
#: Start positions that are looked at together before single ones are, from coarse to fine; each divides the one before.
BANDS = (16, 4)
#: Up to so many rows, a table of spans is sent to every task instead of joined to.
BROADCAST_ROWS = 500_000
BROADCAST_IDS = 2_000_000


def sliding(values: np.ndarray, width: int, f) -> np.ndarray:
    """f over [i, i + width) for each i; windows are cut at the end."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = f(out[:-step], out[step:])
        have += step
    return out


def anchors(raw: np.ndarray, offsets: np.ndarray, sums: np.ndarray, length: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): for each anchor the range of start positions that it answers for.

    A start position of ``length`` bytes answers to the first place with the least hash among the WINDOW places from it on.
    """
    n = len(raw) - gram + 1
    if n <= 0:
        return (np.zeros(0, int),) * 3
    at = np.arange(n)
    h = span_names(sums, at, at + gram)
    least = sliding(h, window, np.minimum)
    end = np.repeat(offsets[1:], np.diff(offsets))[:n]
    p = np.flatnonzero(at + length <= end)
    # places that are the least of some window; then for each start the first of them that is the least of its own
    mark = np.zeros(n, np.uint64)
    mark[p] = least[p]
    places = np.flatnonzero(h == sliding(mark[::-1], window, np.maximum)[::-1])
    k = np.searchsorted(places, p)
    open_ = np.flatnonzero(h[places[k]] != least[p]) if len(p) else p
    while len(open_):
        k[open_] += 1
        open_ = open_[h[places[k[open_]]] != least[p[open_]]]
    cut = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(p) else np.zeros(0, int)
    stop = np.append(cut[1:], len(p))[: len(cut)] - 1
    return places[k[cut]], p[cut], p[stop]


def _text_id(body: Column) -> Column:
    """A text's identity: its MD5, 128 bits."""
    return F.unhex(F.md5(body.cast("binary")))


def contexts(docs: DataFrame, text: str, length: int, window: int, gram: int) -> DataFrame:
    """(tail, context, check, id, at, first, last) of the anchors of texts of ``length`` bytes or more; id names the text."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(_text_id(body).alias("id"), body.alias("text")).filter(F.octet_length("text") >= length)

    def make():
        def fn(raw, offsets, part):
            sums = prefix_sums(raw)
            a, first, last = anchors(raw, offsets, sums, length, window, gram)
            doc = np.searchsorted(offsets, a, "right") - 1
            tail = span_names(sums, a, a + length - window + 1)
            context, check = _whole(sums, mixed_sums(raw), a, first, last, length)
            return _batch(part.column(0), doc, offsets[doc], tail, context, check, a, first, last)

        return fn

    return expand_text(rows, "text", ["id"], make, _kind(ROW))


ROW = "tail long, context long, check long, id binary, at int, first int, last int"


def _whole(sums: np.ndarray, mixed: np.ndarray, a: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two names, from sums of two kinds, of all that the strings starting from first to last hold; the first names as well where they start."""
    place = (a - first).astype(np.uint64) * np.uint64(1 << 20) + (a - last).astype(np.uint64)
    return mix(span_names(sums, first, last + length) + mix(place)), span_names(mixed, first, last + length - EIGHT + 1)


def _batch(ids: pa.Array, doc: np.ndarray, start: np.ndarray, tail, context, check, a, first, last) -> pa.RecordBatch:
    places = [pa.array((x - start).astype(np.int32)) for x in (a, first, last)]
    names = [pa.array(x.view(np.int64)) for x in (tail, context, check)]
    return pa.RecordBatch.from_arrays([*names, ids.take(pa.array(doc)), *places], names=["tail", "context", "check", "id", "at", "first", "last"])


def _kind(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def _texts(docs: DataFrame, text: str, places: DataFrame) -> DataFrame:
    """(id, places, text): each text once for which there are places. Other texts aren't shuffled while the ids are few
    enough to be sent to every task (counted)."""
    grouped = durable(places.groupBy("id").agg(F.collect_set(F.struct("at", "first", "last")).alias("places")), "places")  # a text's own places
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(_text_id(body).alias("id"), body.alias("text"))
    if grouped.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(grouped.select("id")), "id", "left_semi")
    return rows.groupBy("id").agg(F.first("text").alias("text")).join(grouped, "id")


def _places(part: pa.RecordBatch, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text number, at, first, last) of all places of a batch, as places in the joined texts."""
    lists = part.column(1)
    doc = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
    flat = lists.flatten()
    return doc, *[offsets[doc] + flat.field(k).to_numpy() for k in range(3)]


def bands(docs: DataFrame, text: str, reps: DataFrame, length: int, width: int, band: int) -> DataFrame:
    """The bands of ``band`` start positions below the places ``reps`` that answer for ``width``: as ``contexts``, with the bytes
    that all strings of a full band share as the tail."""
    rows = _texts(docs, text, reps)

    def make():
        def fn(raw, offsets, part):
            sums, mixed = prefix_sums(raw), mixed_sums(raw)
            doc, a, first, last = _places(part, offsets)
            out = []
            for j in range(0, width, band):
                high = a - j
                f, l = np.maximum(first, high - band + 1), np.minimum(last, high)
                some = f <= l
                h = high[some]
                core = mix(span_names(sums, h, h - band + 1 + length) + np.uint64(j))
                out.append((core, *_whole(sums, mixed, h, f[some], l[some], length), h, f[some], l[some], doc[some]))
            core, full, check, high, f, l, of = (np.concatenate(c) for c in zip(*out, strict=True))
            return _batch(part.column(0), of, offsets[of], core, full, check, high, f, l)

        return fn

    return expand_text(rows, "text", ["id", "places"], make, _kind(ROW))


def kinds(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows whose tail occurs twice or more: the ranges (id, first, last) of those whose context does, and one place
    (id, at, first, last) of each kind of context under tails with several.

    Both sides of the joins are tables, so that adaptive execution can split a group that holds many rows.
    """
    often = durable(rows.groupBy("tail").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tail"), "groups")
    rows = durable(rows.join(often, "tail", "left_semi"), "often")
    each = durable(rows.groupBy("tail", "context", "check").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "at", "first", "last")).alias("rep")), "kinds")
    equal = rows.join(each.filter("n > 1").select("tail", "context", "check"), ["tail", "context", "check"], "left_semi").select("id", "first", "last")
    several = durable(each.groupBy("tail").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("tail"), "several")
    return equal, durable(each.join(several, "tail", "left_semi").select("rep.*"), "reps")


def sample_triples(docs: DataFrame, text: str, starts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """The triples of blocks of the sample, (c0, c1, c2, id, q), and what is to be compared, (kind, x, y, id, p, q, r).

    ``starts`` (id, at, first, last); kind 0 compares the sample (two names, then blocks x and y),
    kind 1 classes 0 and 1 (block x, two names, block y), kind 2 classes 0 and 2 (blocks x and y, two names).
    """
    block = length // BLOCKS
    rows = _texts(docs, text, starts)

    def make():
        def fn(raw, offsets, part):
            sums = prefix_sums(raw)
            doc, _, first, last = _places(part, offsets)
            width = last - first + 1
            doc, first = np.repeat(doc, width), np.repeat(first - offsets[doc], width)
            p = first + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            doc, p = np.unique(np.stack([doc, p]), axis=1)
            base = offsets[doc]
            name = lambda of, at: span_names(sums, of + at, of + at + block).view(np.int64)
            cls = (p // block) % 3
            out = []
            for kind, classes, x, y, ahead in ((0, (1, 2), 6, 7, 0), (1, (0, 1), 0, 7, 1), (2, (0, 2), 0, 1, 2)):
                use = (cls == classes[0]) | (cls == classes[1])
                d, at, of = doc[use], p[use], base[use]
                out.append((np.full(len(d), kind), name(of, at + x * block), name(of, at + y * block), d, at, at + ahead * block, at + (ahead + 3) * block))
            kind, x, y, d, at, q, r = (np.concatenate(c) for c in zip(*out, strict=True))
            need = np.unique(np.stack([np.concatenate([d, d]), np.concatenate([q, r])]), axis=1)
            of = offsets[need[0]]
            triple = [name(of, need[1] + k * block) for k in range(3)]
            n, m = len(kind), need.shape[1]
            ids = part.column(0)
            columns = [np.append(kind, np.full(m, -1)).astype(np.int32), np.append(x, triple[0]), np.append(y, triple[1]), np.append(np.zeros(n, np.int64), triple[2])]
            tail = [np.append(at, need[1]).astype(np.int32), np.append(q, need[1]).astype(np.int32), np.append(r, need[1]).astype(np.int32)]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns), ids.take(pa.array(np.append(d, need[0]))), *map(pa.array, tail)], names=["kind", "x", "y", "z", "id", "p", "q", "r"])

        return fn

    schema = _kind("kind int, x long, y long, z long, id binary, p int, q int, r int")
    made = durable(expand_text(rows, "text", ["id", "places"], make, schema), "triples")
    return made.filter("kind = -1").select(F.col("x").alias("c0"), F.col("y").alias("c1"), F.col("z").alias("c2"), "id", "q"), made.filter("kind >= 0").drop("z")


def ranked(rows: DataFrame, keys: list[str], ties: list[str]) -> DataFrame:
    """``rows`` with the rank ``name`` of their keys (equal keys, equal names).

    A sort by ranges of keys and ties; each range is ranked apart and shifted by the ranks before it.
    """
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.repartitionByRange(parts, *keys, *ties).sortWithinPartitions(*keys, *ties)
    width = len(keys)
    ordered = ordered.select(*keys, *[c for c in rows.columns if c not in keys])

    def run(batches):
        part, rank, before = TaskContext.get().partitionId(), -1, None
        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(i).to_numpy() for i in range(width)]
            new = np.zeros(len(batch), bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            new[0] = before != tuple(c[0] for c in columns)
            ranks = rank + np.cumsum(new)
            rank, before = int(ranks[-1]), tuple(c[-1] for c in columns)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(batch), part, np.int32)), pa.array(ranks)], names=[*batch.schema.names, "run", "local"])

    schema = T.StructType([*ordered.schema.fields, T.StructField("run", T.IntegerType()), T.StructField("local", T.LongType())])
    done = durable(ordered.mapInArrow(run, schema), "ranked")
    key = F.struct(*keys)
    runs = done.groupBy("run").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max("local").alias("top")).orderBy("run").collect()  # a row a range
    shift, offset, before = [], 0, None
    for r in runs:
        offset -= before == r["first"]
        shift.append((r["run"], offset))
        offset, before = offset + r["top"] + 1, r["last"]
    table = rows.sparkSession.createDataFrame(shift or [(0, 0)], "run int, shift long")
    return done.join(F.broadcast(table), "run").withColumn("name", F.col("local") + F.col("shift")).drop("run", "local", "shift")


def repeated_starts(docs: DataFrame, text: str, starts: DataFrame, length: int) -> DataFrame:
    """(id, at) of those of the positions ``starts`` whose strings occur again among them, by the suffix sort."""
    triples, compared = sample_triples(docs, text, starts, length)
    names = ranked(triples, ["c0", "c1", "c2"], ["id", "q"]).select("id", "q", "name")
    names = durable(names, "names")
    one = names.select("id", F.col("q"), F.col("name").alias("m"))
    two = names.select("id", F.col("q").alias("r"), F.col("name").alias("n"))
    keyed = compared.join(one, ["id", "q"]).join(two, ["id", "r"])
    order = {0: ("m", "n", "x", "y"), 1: ("x", "m", "n", "y"), 2: ("x", "y", "m", "n")}
    pick = lambda i: F.when(F.col("kind") == 0, F.col(order[0][i])).when(F.col("kind") == 1, F.col(order[1][i])).otherwise(F.col(order[2][i]))
    keyed = durable(keyed.select("kind", *[pick(i).alias(f"k{i}") for i in range(4)], "id", "p"), "keyed")
    ordered = durable(ranked(keyed, ["kind", "k0", "k1", "k2", "k3"], ["id", "p"]).select("name", "id", "p"), "ordered")
    again = ordered.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    return ordered.join(again, "name", "left_semi").select("id", F.col("p").alias("at")).distinct()


def repeated(docs: DataFrame, text: str = "text", length: int = LENGTH, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, first, last): ranges of the positions of texts, named by their MD5, at which repeated strings start."""
    rows, ranges = durable(contexts(docs, text, length, window, gram), "anchors"), None
    for width, band in zip((window, *BANDS), (*BANDS, 1), strict=True):
        equal, reps = kinds(rows)
        ranges = equal if ranges is None else ranges.union(equal)
        if band > 1:
            rows = durable(bands(docs, text, reps, length, width, band), "bands")
    ones = repeated_starts(docs, text, reps, length).select("id", F.col("at").alias("first"), F.col("at").alias("last"))
    return ranges.union(ones)


def _merged(spans: DataFrame) -> DataFrame:
    """(id, spans) with ranges that overlap or touch joined."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            pairs, many = lists.flatten(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(batch)), many)
            first, last = (pairs.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            order = np.lexsort((first, row))
            row, first, last = row[order], first[order], last[order]
            # rows apart from each other, so that a running maximum of ends holds within each
            lift = row * (1 << 33)
            reach = np.maximum.accumulate(last + lift)
            new = np.ones(len(row), bool)
            new[1:] = (first[1:] + lift[1:] > reach[:-1] + 1) | (row[1:] != row[:-1])
            at = np.flatnonzero(new)
            stop = np.append(at[1:], len(row)) - 1
            made = pa.StructArray.from_arrays([pa.array(first[at].astype(np.int32)), pa.array((reach[stop] - lift[stop]).astype(np.int32))], names=["first", "last"])
            cuts = np.searchsorted(row[at], np.arange(len(batch) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), made)], names=["id", "spans"])

    return spans.mapInArrow(run, _kind("id binary, spans array<struct<first: int, last: int>>"))


def cut(raw: np.ndarray, ranges: np.ndarray, length: int) -> tuple[int, np.ndarray]:
    """Number of removed runs and the bytes that stay, for ranges of repeated starts clipped to the text."""
    first, last = np.maximum(ranges[:, 0], 0), np.minimum(ranges[:, 1], len(raw) - length)
    some = first <= last
    step = np.zeros(len(raw) + 1, np.int64)
    np.add.at(step, first[some], 1)
    np.add.at(step, last[some] + length, -1)
    gone = np.cumsum(step[:-1]) > 0
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (gone[:1].sum()))
    return runs, raw[~gone]


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with ``kept`` (the remaining bytes) if asked for."""
    if length % BLOCKS:
        raise ValueError(f"length must be divisible by {BLOCKS}")
    spans = repeated(docs, text, length)
    spans = durable(_merged(spans.groupBy("id").agg(F.collect_set(F.struct("first", "last")).alias("spans"))), "spans")
    if (spans.agg(F.sum(F.size("spans") + 4)).first()[0] or 0) <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), body.alias("text"), _text_id(body).alias("id")).join(spans, "id", "left").select("doc_id", "spans", "text")

    def make():
        def fn(raw, offsets, part):
            lists, sizes = part.column(1), np.diff(offsets)
            removed, runs, digest, kept = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), [], []
            for i in range(len(part)):
                own = raw[offsets[i] : offsets[i + 1]]
                if lists[i].is_valid:
                    pairs = lists[i].values
                    ranges = np.stack([pairs.field(0).to_numpy(), pairs.field(1).to_numpy()], 1)
                    runs[i], own = cut(own, ranges, length)
                    removed[i] = sizes[i] - len(own)
                digest.append(hashlib.sha256(own.tobytes()).hexdigest())
                if keep_text:
                    kept.append(own.tobytes())
            return {"n_bytes": sizes.astype(np.int64), "n_removed": removed, "n_spans": runs, "kept_sha256": digest} | ({"kept": pa.array(kept, pa.binary())} if keep_text else {})

        return fn

    fields = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType())]
    fields += [T.StructField("kept", T.BinaryType())] * keep_text
    return map_text(rows, "text", ["doc_id", "spans"], make, fields).drop("spans")


#: All strings of 400 bytes by their MD5, in hexadecimal.
ORACLE = r"""
WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rid, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS MATERIALIZED (SELECT rid, p, md5_number(substr(h, 2 * p + 1, 800)) AS k FROM (SELECT rid, h, unnest(range(len(h) // 2 - 399)) AS p FROM d WHERE len(h) >= 800)),
r AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
e AS (SELECT rid, p, CASE WHEN p > lag(p) OVER (PARTITION BY rid ORDER BY p) + 400 THEN 1 ELSE 0 END AS fresh FROM s SEMI JOIN r USING (k)),
o AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS run FROM e),
v AS MATERIALIZED (SELECT rid, min(p) AS a, max(p) + 400 AS b FROM o GROUP BY rid, run),
g AS (SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS lo, a AS hi FROM v UNION ALL SELECT rid, max(b), NULL FROM v GROUP BY rid),
t AS (SELECT rid, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, len(h) // 2) - lo)), '' ORDER BY lo) AS kept FROM g JOIN d USING (rid) GROUP BY rid),
c AS (SELECT rid, sum(b - a) AS gone, count(*) AS runs FROM v GROUP BY rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(runs, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN c USING (rid)
"""
