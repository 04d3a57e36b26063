"""N-gram Jaccard join with MinHash banding.

Documents with equal shingle sets are one class. Classes meet in buckets of banded MinHash
signatures; bands and rows are chosen for a target recall. Inside a bucket, classes whose signatures
estimate too low a similarity are let go (four standard errors below the threshold: of pairs just at it
about 3 in 100,000 in each bucket that they share); what is left is grouped into candidate components, and
pairs within a component are verified on the full shingle sets. Tasks give back link counts and a
spanning forest, never the pairs.

Buckets and components of more than ``TILE`` classes have a centre. Members near it are linked to each other for
certain and are counted by sorted sums, a row a member; only members far from it are compared with all, in
cells of bounded size. So rows grow with a group of near copies, not with its square; a group without a centre
(a chain, or chance collisions) still costs its far members times the tiles of the group.

Shingles are runs of five words (lower-case letters, marks and digits); a text of one to four words
has the one shingle of all its words. Defined results: a null or empty text, or one without words, is
linked to texts equal to it only; texts of any length are looked at whole; repeated rows are copies of each other; ids may repeat and may be
null; other columns are ignored by ``near_duplicates`` and passed through by ``one_of_each``; an empty
table gives an empty table. ``class_id`` and ``copy_id`` are ids, so that a class whose ids are all null
shows null; rows are told apart by their id and a 64-bit hash of their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounds, durable, grouped_rows, map_text, text_bytes
from .graph import components
from .words import hashed, mix, normalised, per_text, shingle_sets, word_names

THRESHOLD = Fraction(4, 5)
RECALL = 0.999
MAX_HASHES = 128
TILE = 256
#: Signatures that agree in less than the threshold minus this share are let go inside a bucket (4 standard errors).
SLACK = 4.0
#: Up to so many ids of candidates, they are broadcast to the scan that reads their texts again.
BROADCAST_IDS = 2_000_000


def choose_bands(threshold: float, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which the recall at the threshold holds within ``max_hashes``."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    return best


def set_ids(grams: np.ndarray, cut: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit id of each text's shingle set; of the text itself where it has no words."""
    size = np.diff(cut)
    ids = mix(per_text(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), cut) + size.astype(np.uint64))
    empty = size == 0
    ids[empty] = mix(hashed(raw, offsets[:-1][empty], offsets[1:][empty]) ^ np.uint64(0x94D049BB133111EB))
    return ids.view(np.int64)


def _sets(part: pa.RecordBatch, words: int):
    raw, offsets = text_bytes(normalised(part.column(part.num_columns - 1)))
    names, _, _, doc = word_names(raw, offsets)
    return shingle_sets(names, doc, len(part), words)


def signatures(docs: DataFrame, key: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, text_hash, id, size, bands, signature) of every document."""
    rng = np.random.default_rng(20)
    times = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def make():
        def fn(raw, offsets, part):
            grams, cut = _sets(part, words)
            n = len(part)
            least = np.empty((n, bands * rows), np.uint64)
            for j in range(bands * rows):
                least[:, j] = per_text((grams ^ plus[j]) * times[j], cut, np.minimum)
            size = np.diff(cut)
            keys = np.zeros((n, bands), np.uint64)
            for r in range(rows):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + least[:, r::rows])
            keys = mix(keys + np.arange(bands, dtype=np.uint64))
            some = np.where(size > 0, bands, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(some)).astype(np.int32)), pa.array(keys[size > 0].reshape(-1).view(np.int64)))
            short = np.ascontiguousarray((least >> np.uint64(48)).astype(np.uint16))
            return {"id": set_ids(grams, cut, raw, offsets), "size": size.astype(np.int64), "bands": lists, "signature": _fixed(short.view(np.uint8).reshape(n, -1))}

        return fn

    fields = [T.StructField("id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("signature", T.BinaryType())]
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), _text_hash(text).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    return map_text(source, "text", ["doc_id", "text_hash"], make, fields)


def _text_hash(text: str):
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def _fixed(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _blobs(column: pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def in_cells(members: DataFrame, group: str) -> DataFrame:
    """Members (group, n, heavy_n, heavy, id, ...) in the cells where their pairs are looked at: columns group, i, j, side come first.

    A group of up to TILE members is one cell (side 2). In a larger one only its heavy members (side 1, in strips) meet
    all members (side 0, in tiles), so that rows grow with members and with heavy ones times tiles.
    """
    tiles, strips = (F.ceil(F.col(c) / TILE).cast("int") for c in ("n", "heavy_n"))
    at = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    until = lambda k: F.when(k > 0, F.sequence(F.lit(0), k - 1)).otherwise(F.array().cast("array<int>"))
    place = F.xxhash64("id")
    below = F.transform(until(strips), lambda i: at(i, F.pmod(place, tiles), 0))
    over = F.when(F.col("heavy"), F.transform(until(tiles), lambda j: at(F.pmod(place, strips), j, 1))).otherwise(F.array().cast("array<struct<i:int,j:int,side:int>>"))
    cells = F.when(F.col("n") <= TILE, F.array(at(F.lit(0), F.lit(0), 2))).otherwise(F.concat(below, over))
    rest = [c for c in members.columns if c not in (group, "n", "heavy_n")]
    x = members.withColumn("cell", F.explode(cells)).select(group, "cell.*", *rest)
    return x.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def to_members(members: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """``members`` (with the size n of their group) joined to one row for each key; a large group's members are spread over copies of that row."""
    spread = F.ceil(F.col("n") / (16 * TILE)).cast("int")
    groups = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), spread - 1))).drop("n")
    return members.withColumn("__salt", F.pmod(F.xxhash64("id"), spread).cast("int")).join(groups, [*keys, "__salt"]).drop("__salt")


def _forest(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest member reached from each of n members over the pairs."""
    root = np.arange(n)
    if not len(pairs):
        return root
    a, b = pairs[:, 0], pairs[:, 1]
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _alike(cutoff: float, width: int):
    """Per cell: edges (id, smallest id of its part) between signatures that agree often enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped_rows(batches, 3):
            cut = bounds(batch, 3)
            side, ids = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            sig = np.stack(_blobs(batch.column(6), np.uint16)) if len(batch) else np.zeros((0, width), np.uint16)
            twos = cut[:-1][np.diff(cut) == 2]
            twos = twos[(side[twos] == 2) & ((sig[twos] == sig[twos + 1]).mean(axis=1) >= cutoff)]
            a, b = [ids[twos]], [ids[twos + 1]]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi - lo < 3 and side[lo] == 2:
                    continue
                left, right = np.flatnonzero(side[lo:hi] > 0) + lo, np.flatnonzero(side[lo:hi] != 1) + lo
                found = [np.zeros((0, 2), int)]
                for at in range(0, len(left), 64):
                    x, y = np.nonzero((sig[left[at : at + 64], None, :] == sig[right][None]).mean(axis=2) >= cutoff)
                    found.append(np.stack([left[x + at], right[y]], 1))
                who, at = np.unique(ids[np.concatenate(found)], return_inverse=True)
                root = _forest(len(who), at.reshape(-1, 2))
                a.append(who)
                b.append(who[root])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return run


def alike(met: DataFrame, width: int, cutoff: float) -> DataFrame:
    """(a, b): edges that connect all members (bucket, n, id, signature) of a bucket whose signatures agree in ``cutoff`` of their places.

    A large bucket has a centre, the commonest value of each place. Two members that differ from it in few places agree
    in all others, so that those that are this near (light) are connected at once; the rest (heavy) are compared with all.
    """
    large = met.filter(F.col("n") > TILE)
    small = met.filter(F.col("n") <= TILE).select("bucket", "n", F.lit(0).cast("long").alias("heavy_n"), "id", F.lit(True).alias("heavy"), "signature")
    compared = lambda cells: in_cells(cells, "bucket").mapInArrow(_alike(cutoff, width), "a long, b long")
    if not large.limit(1).count():
        return compared(small)

    def counted(batches):
        for batch in batches:
            if len(batch):
                group, of = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                sig = np.stack(_blobs(batch.column(1), np.uint16)).astype(np.int64)
                code, n = np.unique((of[:, None] * width + np.arange(width)) << 16 | sig, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(group[(code >> 16) // width]), pa.array((code >> 16) % width), pa.array(code & 0xFFFF), pa.array(n)], names=["bucket", "place", "value", "n"])

    values = large.select("bucket", "signature").mapInArrow(counted, "bucket long, place long, value long, n long").groupBy("bucket", "place", "value").agg(F.sum("n").alias("n"))
    centre = values.groupBy("bucket", "place").agg(F.max_by("value", F.struct("n", "value")).alias("value"))
    centre = centre.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("place", "value"))).alias("centre"))  # width values a bucket
    sizes = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    most = width - int(np.ceil(cutoff * width))  # places in which members that are alike may differ

    def measured(batches):
        for batch in batches:
            if len(batch):
                centre = batch.column(4).flatten().field(1).to_numpy().reshape(len(batch), width)
                off = (np.stack(_blobs(batch.column(3), np.uint16)) != centre).sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(2 * off > most)], names=["bucket", "n", "id", "signature", "heavy"])

    large = to_members(large, centre.join(sizes, "bucket"), ["bucket"]).select("bucket", "n", "id", "signature", "centre")
    large = durable(large.mapInArrow(measured, "bucket long, n long, id long, signature binary, heavy boolean"), "measured")
    figures = large.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_if("heavy").alias("heavy_n"), F.min(F.when(~F.col("heavy"), F.col("id"))).alias("light"))
    large = to_members(large, figures, ["bucket"])
    edges = compared(small.unionByName(large.select(small.columns)))
    return edges.union(large.filter(~F.col("heavy")).select(F.col("id").alias("a"), F.col("light").alias("b")))


def _verify(threshold: Fraction):
    """Per cell: (id, linked documents, linked classes, smallest id of its part) over exact similarities; of pairs that the centre doesn't settle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped_rows(batches, 3):
            cut = bounds(batch, 3)
            side, ids, copies, far, heavy = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4, 5, 6, 7))
            out: list[list[np.ndarray]] = [[], [], [], []]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi - lo < 2:
                    continue
                sets = _blobs(batch.column(8).slice(lo, hi - lo), np.uint64)
                left, right = np.flatnonzero(side[lo:hi] > 0), np.flatnonzero(side[lo:hi] != 1)
                linked = similar(sets, threshold)[np.ix_(left, right)]
                left, right = left + lo, right + lo
                linked &= (ids[left][:, None] != ids[right][None]) & (far[left][:, None] + far[right][None] > 0)
                if not linked.any():
                    continue
                # a heavy member's own links are counted where it stands on the left
                back = linked[:, ~heavy[right]]
                who, degree, classes = (np.concatenate(x) for x in ((ids[left], ids[right][~heavy[right]]), (linked @ copies[right], copies[left] @ back), (linked.sum(axis=1), back.sum(axis=0))))
                names, at = np.unique(np.concatenate([ids[left], ids[right]]), return_inverse=True)
                x, y = np.nonzero(linked)
                root = names[_forest(len(names), np.stack([at[: len(left)][x], at[len(left) :][y]], 1))]
                some = degree > 0
                for o, v in zip(out, (who[some], degree[some], classes[some], root[np.searchsorted(names, who[some])]), strict=True):
                    o.append(v.astype(np.int64))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["id", "links", "class_links", "root"])

    return run


def verified(cells: DataFrame, threshold: Fraction) -> DataFrame:
    """(id, links, class_links, root) of the members (root, n, id, copies, shingles) with links, in one or more rows.

    Of a large group the centre r holds the shingles that more than half of the members have. With R the shingles of r
    that a member x lacks and A those that it has besides, two members share |r| - |Rx| - |Ry| + |Rx & Ry| + |Ax & Ay|. So
    they are similar enough, whatever they share of R and A, if far(x) + far(y) <= 0 for a number ``far`` of each member. These links
    are counted by sorted sums; only members with far > 0 (heavy) are compared with all others.
    """
    a, b = threshold.numerator, threshold.denominator
    none = F.lit(0).cast("long")
    large = cells.filter(F.col("n") > TILE)
    small = cells.filter(F.col("n") <= TILE).select("root", "n", none.alias("heavy_n"), "id", "copies", F.lit(1).cast("long").alias("far"), F.lit(True).alias("heavy"), "shingles")
    compared = lambda met: in_cells(met, "root").mapInArrow(_verify(threshold), "id long, links long, class_links long, root long")
    if not large.limit(1).count():
        return compared(small)

    def counted(batches):
        for batch in batches:
            if len(batch):
                sets = _blobs(batch.column(1), np.uint64)
                group, of = np.unique(batch.column(0).to_numpy(), return_inverse=True)
                of, values = np.repeat(of, [len(x) for x in sets]), np.concatenate(sets)
                order = np.lexsort((values, of))
                of, values = of[order], values[order]
                at = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (values[1:] != values[:-1]))[: len(of)])
                yield pa.RecordBatch.from_arrays([pa.array(group[of[at]]), pa.array(values[at].view(np.int64)), pa.array(np.diff(np.append(at, len(of))))], names=["root", "shingle", "n"])

    sizes = large.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    common = large.select("root", "shingles").mapInArrow(counted, "root long, shingle long, n long").groupBy("root", "shingle").agg(F.sum("n").alias("n"))
    centre = common.join(sizes, "root").filter(F.col("n") * 2 > F.col("members")).groupBy("root").agg(F.collect_list("shingle").alias("centre"))
    centre = sizes.select("root", F.col("members").alias("n")).join(centre, "root", "left")

    def measured(batches):
        for batch in batches:
            if len(batch):
                centre, far = batch.column(5), []
                for x, r in zip(_blobs(batch.column(4), np.uint64), centre, strict=True):
                    r = r.values.to_numpy().view(np.uint64) if r.is_valid else np.zeros(0, np.uint64)
                    lacks = len(r) - len(np.intersect1d(x, r, assume_unique=True))
                    far.append(2 * a * len(x) + 2 * (a + b) * lacks - (a + b) * len(r))
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(far, pa.int64())], names=["root", "n", "id", "copies", "shingles", "far"])

    large = to_members(large, centre, ["root"]).select("root", "n", "id", "copies", "shingles", "centre")
    large = durable(large.mapInArrow(measured, "root long, n long, id long, copies long, shingles binary, far long"), "measured").withColumn("heavy", F.col("far") > 0)
    figures = large.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.count_if("heavy").alias("heavy_n"), F.min_by("id", F.struct("far", "id")).alias("near"))
    # classes and documents with far' <= -far: sums over the sorted values, of which a group has few
    bins = durable(large.groupBy("root", "far").agg(F.count(F.lit(1)).alias("classes"), F.sum("copies").alias("docs"), F.max("n").alias("n")), "bins")
    asked = bins.select("root", (-F.col("far")).alias("at"), F.lit(1).alias("asked"), none.alias("classes"), none.alias("docs"), "n")
    line = bins.select("root", F.col("far").alias("at"), F.lit(0).alias("asked"), "classes", "docs", "n").unionByName(asked)
    until = Window.partitionBy("root").orderBy("at", "asked").rowsBetween(Window.unboundedPreceding, 0)
    line = line.select("root", "n", "asked", (-F.col("at")).alias("far"), F.sum("classes").over(until).alias("with_classes"), F.sum("docs").over(until).alias("with_docs")).filter("asked = 1 and with_classes > 0").drop("asked")
    settled = to_members(large.select("root", "n", "id", "copies", "far"), line, ["root", "far"])
    settled = to_members(settled, figures.select("root", "n", "near"), ["root"])
    own = F.when(F.col("far") <= 0, 1).otherwise(0)
    settled = settled.select("id", (F.col("with_docs") - own * F.col("copies")).alias("links"), (F.col("with_classes") - own).alias("class_links"), F.col("near").alias("root")).filter("class_links > 0")
    return compared(small.unionByName(to_members(large, figures.drop("near"), ["root"]).select(small.columns))).unionByName(settled)


def similar(sets: list[np.ndarray], threshold: Fraction, columns: int = 1 << 14) -> np.ndarray:
    """Which pairs of distinct sets have a Jaccard similarity of the threshold or more."""
    n, size = len(sets), np.array([len(s) for s in sets])
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(n), size)
    shared = count > 1
    number = np.cumsum(shared) - 1
    use = shared[at]
    at, of = number[at[use]], of[use]
    common = np.zeros((n, n), np.float64)
    for lo in range(0, int(shared.sum()), columns):
        inside = (at >= lo) & (at < lo + columns)
        m = np.zeros((n, columns), np.float32)
        m[of[inside], at[inside] - lo] = 1
        common += m @ m.T
    common = np.rint(common).astype(np.int64)
    union = size[:, None] + size[None] - common
    linked = common * threshold.denominator >= union * threshold.numerator
    np.fill_diagonal(linked, False)
    return linked


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: Fraction = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: (doc_id, class_id, copy_id, links, class_links).

    copy_id is the smallest id among documents with an equal shingle set, class_id the smallest among
    all that are connected by links (similarity of the threshold or more); links counts the other
    documents linked to this one, class_links the different shingle sets among them.
    """
    signed, known = _classes(docs, key, text, words, threshold, recall)
    smallest = known.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    known = known.join(smallest, "root").select("id", "class_id", "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("class_links", F.lit(0)).alias("class_links"))
    return signed.select("doc_id", "id").join(known, "id").select("doc_id", "class_id", "copy_id", "links", "class_links")


def _classes(docs: DataFrame, key: str, text: str, words: int, threshold: Fraction, recall: float) -> tuple[DataFrame, DataFrame]:
    """The signatures, and (id, copy_id, copies, least, root, links, class_links) of each shingle set.

    least tells one row of the set: its id (the smallest; null where all are) and text hash.
    """
    bands, rows = choose_bands(float(threshold), recall)
    signed = durable(signatures(docs, key, text, words, bands, rows), "signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    classes = signed.groupBy("id").agg(F.min("doc_id").alias("copy_id"), least.alias("least"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("signature").alias("signature"))
    classes = durable(classes, "classes")
    linked = _links(docs, classes, key, text, words, threshold, bands * rows)
    roots = components(linked.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("id").agg(F.sum("links").alias("links"), F.sum("class_links").alias("class_links"))
    known = classes.select("id", "copy_id", "copies", "least").join(roots, F.col("id") == F.col("node"), "left").drop("node").join(counts, "id", "left")
    return signed, durable(known.withColumn("root", F.coalesce("root", "id")), "known")


def _links(docs: DataFrame, classes: DataFrame, key: str, text: str, words: int, threshold: Fraction, width: int) -> DataFrame:
    """(id, links, class_links, root) of every cell in which a class has a verified link."""
    met = classes.select("id", F.explode("bands").alias("bucket"))
    full = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = met.join(full, "bucket").join(classes.select("id", "signature"), "id").select("bucket", "n", "id", "signature")
    met = durable(met, "met")
    p = float(threshold)
    cutoff = p - SLACK * (p * (1 - p) / width) ** 0.5
    part = durable(components(alike(met, width, cutoff)), "parts")
    sizes = part.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    part = durable(part.join(sizes, "root").join(classes.select("id", "least", "copies"), F.col("node") == F.col("id")).select("root", "n", "id", "copies", "least"), "members")
    ids = part.select(F.col("least.doc_id").alias("__of"), F.col("least.text_hash").alias("__hash_of")).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = docs.select(F.col(f"`{key}`").alias("__id"), _text_hash(text).alias("__hash"), F.col(f"`{text}`").alias("text"))
    texts = texts.join(ids, F.col("__id").eqNullSafe(F.col("__of")) & (F.col("__hash") == F.col("__hash_of")), "left_semi")

    def make():
        def fn(raw, offsets, piece):
            grams, cut = _sets(piece, words)
            blob = pa.Array.from_buffers(pa.binary(), len(piece), [None, pa.py_buffer((cut * 8).astype(np.int32)), pa.py_buffer(grams)])
            return {"id": set_ids(grams, cut, raw, offsets), "shingles": blob}

        return fn

    sets = map_text(texts, "text", [], make, [T.StructField("id", T.LongType()), T.StructField("shingles", T.BinaryType())])
    # rows repeated with id and text give one set; they combine before the shuffle
    cells = part.select("root", "n", "id", "copies").join(sets.dropDuplicates(["id"]), "id").select("root", "n", "id", "copies", "shingles")
    return durable(verified(durable(cells, "cells"), threshold), "links")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: Fraction = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents without near duplicates: of each class one row stays, of those with its smallest id."""
    known = _classes(docs, key, text, words, threshold, recall)[1]
    kept = known.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.doc_id").alias("__kept"), F.col("least.text_hash").alias("__kept_hash"))
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.withColumnsRenamed(names).withColumn("__hash", _text_hash(names[text]))
    rows = rows.join(kept, F.col(names[key]).eqNullSafe(F.col("__kept")) & (F.col("__hash") == F.col("__kept_hash")), "left_semi")
    return rows.dropDuplicates([names[key], "__hash"]).select(*[F.col(v).alias(c) for c, v in names.items()])


#: All pairs that share a shingle, by exact similarity; classes by reachability.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS body, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\pL\pM\pN]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT rid, array_to_string(w[pos + 1 : pos + 5], ' ') AS s FROM (SELECT rid, w, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS pos FROM d)),
k AS (SELECT rid, md5(string_agg(s, '|' ORDER BY s)) AS name FROM g GROUP BY rid),
n AS MATERIALIZED (SELECT doc_id, d.rid, coalesce(name, 'text ' || body) AS name FROM d LEFT JOIN k USING (rid)),
c AS MATERIALIZED (SELECT name, min(doc_id) AS copy_id, count(*) AS copies, min(rid) AS rid FROM n GROUP BY name),
cs AS MATERIALIZED (SELECT c.rid AS id, s FROM c JOIN g USING (rid)),
z AS (SELECT id, count(*) AS size FROM cs GROUP BY id),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS inter FROM cs a JOIN cs b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
l AS MATERIALIZED (SELECT x, y FROM p JOIN z a ON a.id = x JOIN z b ON b.id = y WHERE inter * 5 >= 4 * (a.size + b.size - inter)),
r AS (SELECT rid AS x, rid AS y FROM c UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y),
label AS (SELECT r.x AS rid, min(c.copy_id) AS class_id FROM r JOIN c ON c.rid = r.y GROUP BY r.x),
links AS (SELECT x AS rid, sum(copies) AS links, count(*) AS class_links FROM l JOIN c ON c.rid = y GROUP BY x)
SELECT n.doc_id, class_id, copy_id, (coalesce(links, 0) + copies - 1)::BIGINT AS links, coalesce(class_links, 0)::BIGINT AS class_links
FROM n JOIN c USING (name) JOIN label ON label.rid = c.rid LEFT JOIN links ON links.rid = c.rid
"""
