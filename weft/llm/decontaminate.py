"""Benchmark decontamination with SimHash over item-sized windows.

A document is slid through windows that have as many words as a benchmark item. Windows that hold no
five-word shingle of any item of that size can't be similar to one and are passed over (this loses
nothing). The others get a 64-bit SimHash of their shingles, weighted by how often each occurs. An
index of ``BLOCKS`` blocks of the fingerprint finds every item fingerprint within ``RADIUS`` bits: if at
most RADIUS bits differ in all, at most RADIUS // BLOCKS differ in some block, and each item stands in
the block's table under all keys that near. Candidates are verified by the exact weighted Jaccard
similarity (sum of smaller counts over sum of larger counts) of the shingles.

The benchmark is sent to all tasks in blocks of about ``BLOCK_BYTES`` of text and ``BLOCK_ITEMS`` items at most; a larger
benchmark takes several passes. Documents are never shuffled.

Defined results: null and empty texts and texts without words hold nothing; an item without words is
never found; an item of one to four words is found where these words stand in a row; a text that is
shorter than an item is one window; of repeated ids and rows each row is looked at and the best match of an id
and item counts; texts of any length are looked at whole, with sums around ``HITS`` shared shingles at a time; an empty table gives an empty table; other columns are ignored or passed through, whatever their names.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import expand_text, map_text, text_bytes
from .words import chain, normalised, word_names

THRESHOLD = Fraction(4, 5)
WORDS = 5
RADIUS = 20
BLOCKS = 7
#: Shingles that an item has as well, which numpy looks at together.
HITS = 4096
#: Text of the benchmark that is sent to the tasks at a time.
BLOCK_BYTES = 16 << 20
#: Items of the benchmark that are sent at a time; short ones are more index than text.
BLOCK_ITEMS = 1 << 17
#: Candidates whose distance is taken together.
CANDIDATES = 1 << 20


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """64-bit SimHash of rows of 64 signed sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def signs(grams: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(grams).view(np.uint8), bitorder="little").reshape(-1, 64)
    return bits.astype(np.int32) * 2 - 1


@functools.cache
def _flips(width: int, bits: int) -> np.ndarray:
    """All numbers of ``width`` bits with at most ``bits`` set."""
    return np.array([sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(width), k)], np.int64)


class Blocks:
    """Multi-index over fingerprints: ``near(fp)`` gives all pairs (query, item) within the radius, and no others.

    Each block holds the items once, in the order of their bits there; a query looks up all keys that near.
    """

    def __init__(self, items: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        self.items, self.radius, self.bits = items, radius, radius // blocks
        edges = np.linspace(0, 64, blocks + 1).astype(int).tolist()
        self.parts = []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            own = self._keys(items, lo, hi).astype(np.int32)
            who = np.argsort(own, kind="stable").astype(np.int32)
            self.parts.append((lo, hi, own[who], who))

    @staticmethod
    def _keys(fp: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return ((fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)).astype(np.int64)

    def near(self, fp: np.ndarray, step: int = CANDIDATES) -> tuple[np.ndarray, np.ndarray]:
        """Looks at ``step`` candidates at a time, or at those of one query."""
        tables, many = [], np.zeros(len(fp), np.int64)
        for lo, hi, own, who in self.parts:
            starts = np.searchsorted(own, np.arange((1 << (hi - lo)) + 1))
            flips = _flips(hi - lo, self.bits)
            around = np.diff(starts)[np.arange(1 << (hi - lo))[:, None] ^ flips].sum(axis=1)
            key = self._keys(fp, lo, hi)
            many += around[key]
            tables.append((key, around[key] > 0, starts, flips, who))
        ends, found, at = np.cumsum(many), [np.zeros(0, np.int64)], 0
        while at < len(fp):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + step, "right")))
            found += [self._close(fp, at + np.flatnonzero(some[at:to]), key, starts, flips, who) for key, some, starts, flips, who in tables]
            at = to
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.items), pairs % len(self.items)

    def _close(self, fp, query, key, starts, flips, who) -> np.ndarray:
        keys = (key[query][:, None] ^ flips).ravel()
        count = starts[keys + 1] - starts[keys]
        query = np.repeat(np.repeat(query, len(flips)), count)
        item = who[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - starts[keys], count)]
        close = np.bitwise_count(fp[query] ^ self.items[item]) <= self.radius
        return query[close] * len(self.items) + item[close]


@dataclass
class Index:
    """One block of the benchmark, ready to be looked up."""

    ids: np.ndarray
    grams: list[np.ndarray]
    sizes: np.ndarray
    shingles: np.ndarray = field(init=False)
    windows: dict[int, tuple[np.ndarray, Blocks]] = field(init=False)
    owners: dict[int, np.ndarray] = field(init=False)
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(init=False)

    def __post_init__(self):
        self.windows, self.owners, self.short = {}, {}, {}
        for n in np.unique(self.sizes[self.sizes > 0]).tolist():
            own = np.flatnonzero(self.sizes == n)
            if n < WORDS:
                values = np.array([self.grams[i][0] for i in own], np.uint64)
                order = np.argsort(values, kind="stable")
                self.short[n] = values[order], own[order]
                continue
            fp = fingerprints(np.stack([signs(self.grams[i]).sum(axis=0) for i in own]))
            self.windows[n] = own, Blocks(fp)
            self.owners[n] = np.unique(np.concatenate([self.grams[i] for i in own]))
        self.shingles = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.owners.values()]))


def index_of(ids: list, texts: list) -> Index:
    raw, offsets = text_bytes(normalised(pa.array(texts, pa.string())))
    names, _, _, doc = word_names(raw, offsets)
    cut = np.searchsorted(doc, np.arange(len(texts) + 1))
    size = np.diff(cut)
    grams = [chain(names[a:b], min(WORDS, max(int(b - a), 1))) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return Index(np.array(ids, object), grams, size)


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def find(index: Index, names: np.ndarray, doc: np.ndarray, threshold: Fraction = THRESHOLD) -> tuple[np.ndarray, ...]:
    """Best window for each text and item: (text, item, first word, similarity)."""
    rows: list[tuple[int, int, int, float]] = []
    first = np.searchsorted(doc, doc, "left") if len(doc) else doc
    last = np.searchsorted(doc, doc, "right") if len(doc) else doc
    for n, (values, own) in index.short.items():
        grams = chain(names, n)
        hit = np.flatnonzero(member(grams, values) & (doc[: len(grams)] == doc[n - 1 :]))
        for at in hit.tolist():
            for k in range(np.searchsorted(values, grams[at]), np.searchsorted(values, grams[at], "right")):
                rows.append((int(doc[at]), int(own[k]), at - int(first[at]), 1.0))
    grams = chain(names, WORDS)
    if len(grams) and len(index.shingles):
        inside = doc[: len(grams)] == doc[WORDS - 1 :]
        hits = np.flatnonzero(member(grams, index.shingles) & inside)
        if len(hits):
            for part in range(0, len(hits), HITS):
                rows += _windows(index, grams, hits[part : part + HITS], doc, first, last, threshold)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for d, i, at, similarity in rows:
        if (similarity, -at) > best.get((d, i), (-1.0, 0)):
            best[d, i] = similarity, -at
    return tuple(np.array(x) for x in zip(*((d, i, -at, s) for (d, i), (s, at) in sorted(best.items())), strict=True)) if best else tuple(np.zeros(0, k) for k in (int, int, int, float))


def _windows(index: Index, grams, hits, doc, first, last, threshold: Fraction):
    # the signs of the shingles that a window with a hit may hold, summed up
    reach = max(index.windows)
    near = np.zeros(len(grams) + 1, np.int32)
    np.add.at(near, np.maximum(hits - reach, first[hits]), 1)
    np.add.at(near, np.minimum(np.minimum(hits + reach, last[hits]), len(grams)), -1)
    used = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    place = np.full(len(grams) + 1, -1)
    place[used] = np.arange(len(used))
    sums = np.zeros((len(used) + 1, 64), np.int32)
    np.cumsum(signs(grams[used]), axis=0, out=sums[1:])
    for n, (own, blocks) in index.windows.items():
        at = hits[member(grams[hits], index.owners[n])]
        if not len(at):
            continue
        # windows [s, s + n) that hold a hit; the whole text where it is shorter
        lo, hi = np.maximum(at - (n - WORDS), first[at]), np.minimum(at, last[at] - n)
        lo = np.where(hi < first[at], first[at], lo)
        hi = np.maximum(hi, first[at])
        cover = np.zeros(len(grams) + 2, np.int32)
        np.add.at(cover, lo, 1)
        np.add.at(cover, hi + 1, -1)
        start = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        count = np.minimum(n, last[start] - start) - WORDS + 1
        start, count = start[count > 0], count[count > 0]
        for part in range(0, len(start), 1 << 14):
            s, c = start[part : part + (1 << 14)], count[part : part + (1 << 14)]
            query, item = blocks.near(fingerprints(sums[place[s] + c] - sums[place[s]]))
            for q, k in zip(query.tolist(), item.tolist(), strict=True):
                inter, union = overlap(grams[s[q] : s[q] + c[q]], index.grams[own[k]])
                if inter * threshold.denominator >= union * threshold.numerator:
                    yield int(doc[s[q]]), int(own[k]), int(s[q] - first[s[q]]), inter / union


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sum of the smaller and of the larger counts of two multisets of shingles."""
    x, m = np.unique(a, return_counts=True)
    y, n = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    inter = int(np.minimum(m[i], n[j]).sum())
    return inter, len(a) + len(b) - inter


def _indices(bench: DataFrame, item: str, text: str):
    """The benchmark's indices, one block after the other, each within the bound."""
    rows = bench.select(F.col(f"`{item}`").alias("i"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t")).distinct()
    size, items = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)), F.count(F.lit(1))).first()
    parts = max(1, -(-size // BLOCK_BYTES), -(-items // BLOCK_ITEMS))
    for k in range(parts):
        block = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        got = block.collect()  # one block at a time
        yield index_of([r["i"] for r in got], [r["t"] for r in got])


def _finder(held):
    def fn(part: pa.RecordBatch):
        raw, offsets = text_bytes(normalised(part.column(part.num_columns - 1)))
        names, _, _, doc = word_names(raw, offsets)
        return find(held.value, names, doc)

    return fn


def leaks(docs: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, similarity): the best window of each document for each item that it holds."""
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    id_, doc_id = T.StructField("item_id", bench.schema[item].dataType), rows.schema["doc_id"]
    schema = T.StructType([doc_id, id_, T.StructField("first_word", T.LongType()), T.StructField("similarity", T.DoubleType())])
    out = None
    for index in _indices(bench, item, item_text):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def make(held=held):
            finder = _finder(held)

            def fn(raw, offsets, part):
                d, i, at, similarity = finder(part)
                items = [held.value.ids[k] for k in i]
                kind = part.schema.field(0).type
                columns = [part.column(0).take(pa.array(d, pa.int64())).cast(kind), pa.array(items), pa.array(at, pa.int64()), pa.array(similarity, pa.float64())]
                return pa.RecordBatch.from_arrays(columns, names=schema.names) if len(d) else None

            return fn

        found = expand_text(rows, "text", ["doc_id"], make, schema)
        out = found if out is None else out.union(found)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("at"))).alias("best")
    out = out.groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", (-F.col("best.at")).alias("first_word"), F.col("best.similarity").alias("similarity"))


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with the columns they came with."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    out = docs.withColumnsRenamed(names)
    for index in _indices(bench, item, item_text):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def make(held=held):
            finder = _finder(held)

            def fn(raw, offsets, part):
                bad = np.zeros(len(part), bool)
                bad[finder(part)[0].astype(int)] = True
                return {"__bad": bad}

            return fn

        out = map_text(out, names[text], list(names.values()), make, [T.StructField("__bad", T.BooleanType())]).filter("not __bad").drop("__bad")
    return out.select(*[F.col(v).alias(c) for c, v in names.items()])


#: Every window that shares a shingle with an item, by exact similarity: what the fingerprints may pass over is not passed over here.
ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\pL\pM\pN]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, row_number() OVER () AS iid, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\pL\pM\pN]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark),
g AS MATERIALIZED (SELECT rid, pos, array_to_string(w[pos + 1 : pos + 5], ' ') AS s FROM (SELECT rid, w, unnest(range(len(w) - 4)) AS pos FROM d WHERE len(w) >= 5)),
ig AS MATERIALIZED (SELECT iid, s, count(*) AS n FROM (SELECT iid, array_to_string(w[pos + 1 : pos + 5], ' ') AS s FROM (SELECT iid, w, unnest(range(len(w) - 4)) AS pos FROM i WHERE len(w) >= 5)) GROUP BY iid, s),
hit AS (SELECT DISTINCT rid, iid, pos FROM g JOIN ig USING (s)),
sized AS (SELECT rid, iid, pos, len(i.w) AS n, len(d.w) AS m FROM hit JOIN d USING (rid) JOIN i USING (iid)),
win AS MATERIALIZED (SELECT DISTINCT rid, iid, n, m, lead_ FROM (SELECT rid, iid, n, m, unnest(CASE WHEN m <= n THEN [0] ELSE range(greatest(pos - (n - 5), 0), least(pos, m - n) + 1) END) AS lead_ FROM sized)),
part AS (SELECT win.rid, win.iid, lead_, g.s, count(*) AS c FROM win JOIN g ON g.rid = win.rid AND g.pos >= lead_ AND g.pos <= lead_ + least(n, m - lead_) - 5 GROUP BY ALL),
met AS (SELECT rid, iid, lead_, sum(least(c, coalesce(n, 0))) AS inter, sum(c) AS own FROM part LEFT JOIN ig USING (iid, s) GROUP BY ALL),
scored AS (SELECT rid, iid, lead_, inter::BIGINT AS inter, (own + (SELECT sum(n) FROM ig WHERE ig.iid = met.iid) - inter)::BIGINT AS uni FROM met),
short AS (SELECT rid, iid, pos AS lead_, 1 AS inter, 1 AS uni FROM (SELECT rid, w, unnest(range(len(w))) AS pos FROM d) x, (SELECT iid, w AS v FROM i WHERE len(w) BETWEEN 1 AND 4) y WHERE w[pos + 1 : pos + len(v)] = v)
SELECT doc_id, item_id, arg_min(lead_, (-inter / uni, lead_))::BIGINT AS first_word, max(inter / uni)::DOUBLE AS similarity
FROM (SELECT * FROM scored WHERE inter * 5 >= uni * 4 UNION ALL SELECT * FROM short) JOIN d USING (rid) JOIN i USING (iid) GROUP BY doc_id, item_id
"""
