"""Importance resampling of documents towards a target text distribution, on hashed n-grams.

Every run of n words is a feature with a bucket (CRC-32 modulo ``buckets``). The documents' and the target's features
are counted by bucket; a bucket's gain is the logarithm of how much likelier it is in the target, and a document's weight
is the mean gain of its features. Adding Gumbel noise from a hash of the id and keeping the highest scores draws documents
without replacement in proportion to their weights.

A text above ``CHUNK`` bytes is cut at word boundaries into overlapping chunks, which are dealt to tasks of their own: a
chunk owns the features that start in it and carries the n-1 words after it, so that each feature is counted once. Counts and
gains of chunks are summed by document. Shorter texts are one chunk and stay where they are read.

What goes to every task is the table of gains, ``buckets`` numbers. Ranks come from ranges of the sorted scores and the
number of rows before each range.

Defined results: a null or empty text has no features and weight 0; rows that repeat, or share an id, are documents of
their own, each returned; a null id is hashed as an empty text and is last among ties; ties of score and id are ordered by the
text's hash; an empty table gives no rows, an empty target gains 0 or less; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, durable, expand_text, slices, text_bytes
from .words import ascii_lower, spans

#: Longer texts are cut; a chunk owns about so many bytes.
CHUNK = 1 << 16
BUCKETS = 10_000
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LETTERS = _INSIDE.copy()
_LETTERS[65:91] = True
#: Features above so many bytes are hashed one at a time.
_LONG = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def crc32(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span, a byte of all spans at a time."""
    out = np.zeros(len(starts), np.uint32)
    size = ends - starts
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = zlib.crc32(raw[starts[i] : ends[i]].tobytes())
    at = np.flatnonzero(size <= _LONG)
    at = at[np.argsort(-size[at], kind="stable")]
    left, state = size[at], np.full(len(at), 0xFFFFFFFF, np.uint32)
    for k in range(int(left[0]) if len(at) else 0):
        n = int(np.searchsorted(-left, -k))  # spans longer than k
        state[:n] = _CRC[(state[:n] ^ raw[starts[at[:n]] + k]) & 0xFF] ^ (state[:n] >> 8)
    out[at] = state ^ np.uint32(0xFFFFFFFF)
    return out


def features(raw: np.ndarray, offsets: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of each run of n words, and the number of words of each text."""
    low = ascii_lower(raw)
    starts, ends, doc = spans(low, offsets, _INSIDE[low])
    words = np.bincount(doc, minlength=len(offsets) - 1)
    if n > 1:  # the words again, a single space after each
        size = ends - starts + 1
        to = np.cumsum(size) - size
        joined = np.full(int(size.sum()), 0x20, np.uint8)
        where = np.repeat(to - starts, size - 1) + (np.arange(int((size - 1).sum())) - np.repeat(np.cumsum(size - 1) - size + 1, size - 1) + np.repeat(starts, size - 1))
        joined[where] = low[where - np.repeat(to - starts, size - 1)]
        low, starts, ends = joined, to, to + size - 1
        whole = np.flatnonzero(doc[: max(0, len(doc) - n + 1)] == doc[n - 1 :])
        starts, ends, doc = starts[whole], ends[whole + n - 1], doc[whole]
    return (crc32(low, starts, ends) % np.uint32(buckets)).astype(np.int64), doc, words


def chunks(raw: np.ndarray, n: int, size: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, words owned) of the chunks of one text; the last n-1 words of a chunk are the next one's first."""
    starts, ends, _ = spans(raw, np.array([0, len(raw)]), _LETTERS[raw])
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + size)))
        yield int(starts[first]), int(ends[min(last + n - 1, len(ends)) - 1]), last - first
        first = last


def cut_long(df: DataFrame, text: str, keep: list[str], n: int, size: int) -> DataFrame:
    """(keep, part, owned, text): the chunks of texts above ``size`` bytes, dealt to all tasks."""
    source = df.select(*keep, F.col(f"`{text}`").cast("string").alias("text")).filter(F.octet_length("text") > size)

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                raw = text_bytes(row.column(len(keep)))[0]
                body, held = raw.tobytes(), []
                for part, (a, b, owned) in enumerate(chunks(raw, n, size)):
                    held.append((part, owned, body[a:b].decode("utf-8", "replace")))
                    if len(held) == 64:
                        yield made(row, held)
                        held = []
                if held:
                    yield made(row, held)

    def made(row, held):
        again = pa.array(np.zeros(len(held), np.int64))
        parts, owned, texts = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([*[c.take(again) for c in row.columns[: len(keep)]], pa.array(parts, pa.int64()), pa.array(owned, pa.int64()), pa.array(texts, pa.string())], names=[*keep, "part", "owned", "text"])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "text"]
    cut = source.mapInArrow(run, ", ".join([*kinds, "part long, owned long, text string"]))
    return cut.repartition(F.xxhash64(*keep, "part"))


def pieces(df: DataFrame, text: str, keep: list[str], n: int, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Texts of one chunk, and the chunks of the others."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    short = df.select(*keep, F.lit(0).cast("long").alias("part"), F.lit(None).cast("long").alias("owned"), body.alias("text"))
    return short.filter(F.octet_length("text") <= size), cut_long(df, text, keep, n, size)


def _owned(doc: np.ndarray, batch: pa.RecordBatch, column: int, n: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which features count: those that start at an owned word; and the words owned by each piece."""
    own = batch.column(column)
    own = np.where(np.asarray(own.is_null()), words, own.fill_null(0).to_numpy(zero_copy_only=False))
    first = np.searchsorted(doc, np.arange(len(own)))
    return np.arange(len(doc)) - first[doc] < own[doc], own


def bucket_counts(df: DataFrame, text: str = "text", n: int = 1, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """(bucket, count) of all features of a table, added up in each task before the shuffle."""

    def make():
        total = np.zeros(buckets, np.int64)

        def run(raw, offsets, batch):
            of, doc, words = features(raw, offsets, n, buckets)
            keep, _ = _owned(doc, batch, 0, n, words)
            np.add(total, np.bincount(of[keep], minlength=buckets), out=total)

        def flush():
            full = np.flatnonzero(total)
            if full.size:
                yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["bucket", "count"])

        run.flush = flush
        return run

    short, long = pieces(df, text, [], n, size)
    found = [expand_text(x, "text", ["owned"], make, "bucket long, count long") for x in (short, long)]
    return found[0].union(found[1]).groupBy("bucket").agg(F.sum("count").alias("count"))


def gains(docs: DataFrame, target: DataFrame, text: str, target_text: str, n: int, buckets: int, size: int) -> np.ndarray:
    """The gain of every bucket, floored thousandths; ``buckets`` rows of counts come to the driver."""

    def counted(df, column):
        out = np.zeros(buckets, np.int64)
        rows = bucket_counts(df, column, n, buckets, size).toArrow()
        out[rows.column("bucket").to_numpy()] = rows.column("count").to_numpy()
        return out

    s, t = counted(docs, text), counted(target, target_text)
    ratio = (t + 1.0) * float(s.sum() + buckets) / ((s + 1.0) * float(t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = BUCKETS, size: int = CHUNK) -> DataFrame:
    """(doc_id, tie, n_words, n_features, weight) of every document; ``tie`` is a hash of its text."""
    gain = docs.sparkSession.sparkContext.broadcast(gains(docs, target, text, target_text, n, buckets, size))

    def make():
        def run(raw, offsets, batch):
            of, doc, words = features(raw, offsets, n, buckets)
            keep, own = _owned(doc, batch, 3, n, words)
            of, doc = of[keep], doc[keep]
            total = np.zeros(len(own), np.int64)
            np.add.at(total, doc, gain.value[of])
            columns = [*batch.columns[:3], pa.array(own.astype(np.int64)), pa.array(np.bincount(doc, minlength=len(own)).astype(np.int64)), pa.array(total)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "tie", "part", "n_words", "n_features", "total"])

        return run

    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("doc_id"), F.xxhash64(body).alias("tie"), body.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    short, long = pieces(rows, "text", ["doc_id", "tie"], n, size)
    found = [expand_text(x, "text", ["doc_id", "tie", "part", "owned"], make, f"doc_id {kind}, tie long, part long, n_words long, n_features long, total long") for x in (short, long)]
    # chunks of a row that stands twice come twice: one of each is summed, and the sum stands as often
    parts = found[1].groupBy("doc_id", "tie", "part").agg(F.count(F.lit(1)).alias("copies"), *[F.max(c).alias(c) for c in ("n_words", "n_features", "total")])
    whole = parts.groupBy("doc_id", "tie").agg(F.max("copies").alias("copies"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "total")])
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    empty = long_without_words(rows, size)
    columns = ["doc_id", "tie", "n_words", "n_features", "total"]
    out = found[0].select(columns).union(whole.select(columns)).union(empty.select(columns))
    floored = F.expr("case when n_features > 0 then (total - pmod(total, n_features)) div n_features else 0 end")
    return out.select("doc_id", "tie", "n_words", "n_features", floored.cast("long").alias("weight"))


def long_without_words(rows: DataFrame, size: int) -> DataFrame:
    """Texts above a chunk that hold no word, and so no chunk."""
    zero = F.lit(0).cast("long")
    empty = rows.filter(F.octet_length("text") > size).filter(~F.col("text").rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]"))
    return empty.select("doc_id", "tie", zero.alias("n_words"), zero.alias("n_features"), zero.alias("total"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024, size: int = CHUNK) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null for those not drawn."""
    scored = weights(docs, target, key, text, target_text, n, buckets, size)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = durable(scored.withColumn("score", F.col("weight") + noise), "scored")
    eligible = scored.filter(F.col("n_words") >= least_words)
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie"), F.asc("spread")]
    ranges = eligible.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = durable(ranges.select("doc_id", "n_features", "weight", "score", F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("at")), "ranges")
    starts = ranges.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).orderBy("run").collect()  # a row a range
    offsets, before = [], 0
    for row in starts:
        offsets.append((row["run"], before + 1 - row["first"]))
        before += row["n"]
    drawn = before * percent // 100
    shift = docs.sparkSession.createDataFrame(offsets, "run int, shift long")
    rank = F.col("at") + F.col("shift")
    ranked = ranges.join(F.broadcast(shift), "run").withColumn("rank", F.when(rank <= drawn, rank))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).union(rest.select(columns))


#: CRC-32 of distinct words in SQL: a table of 256 remainders from the polynomial, then a step a byte.
ORACLE = r"""
WITH k AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS rn, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
e AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS MATERIALIZED (SELECT rn, w, count(*) AS n FROM (SELECT rn, unnest(ws) AS w FROM d) GROUP BY ALL),
ew AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM e) GROUP BY w),
v AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION ALL SELECT w FROM ew)),
b AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, y: xor(c >> 8, crc[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM v, k),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM ew JOIN b USING (w) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT rn, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY rn),
r AS (SELECT doc_id, d.rn, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN ((total - ((total % n_features) + n_features) % n_features) // n_features)::BIGINT ELSE 0 END AS weight,
             ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN m USING (rn)),
c AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS eligible FROM c)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (10 * eligible) // 100 THEN place END AS rank FROM o
"""
