"""Language-model scores by deleted interpolation.

Bigram, unigram and uniform maximum-likelihood estimates are mixed; the mixture weights depend on how
often the context was seen (buckets by powers of two) and are learned by expectation-maximisation on
the bigram counts of a part of the training documents that the estimates leave out. The final estimates
use all training documents. Two passes read the texts:

1. Words are counted. The most frequent (``WORDS`` at most) are numbered by rank and go to every task; all others are rare.
2. Texts become blocks of about ``BLOCK`` word numbers. Pairs with a rare word leave them as rows and meet their
   counts in joins.

Each block then asks for its distinct pairs: they go, with their counts in the block, to the partitions of pairs,
are added up there, and the whole corpus's counts go back to the block in the order asked for. A pair has one
record a block and not one a document, and no sum is split over tasks: a block scores its documents whole. What is moved grows with
the number of blocks. Numbers travel in compressed columns (``pack``), a cell for each block and partition.

Defined results: a null or empty text is one end token; texts of any length count whole; repeated rows
count as often as they occur and each gets its row; a null id trains and scores as an empty one; a table without
training rows gives a uniform model over one word, log10 probability 0; an empty table gives an empty table;
columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, expand_text, fold_of
from .words import ascii_lower, hashed, mix, per_text, spans

FOLDS = 10
#: One training document in so many is left out while the mixture weights are learned.
LEFT_OUT = 10
#: Words that are sent to every task, at most (20 bytes each).
WORDS = 1 << 20
BUCKETS = 40
ROUNDS = 12
END = np.uint64(0x1F83D9ABFB41BD6B)
#: Tokens of a block, tokens for each partition of pairs, and word counts that a task holds.
BLOCK = 1_000_000
PAIRS = 1_000_000
HELD = 1_000_000
#: Partitions of pairs, or blocks, that one task looks at, one after the other.
GROUP = 4


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the tokens of all texts, each text's end token last, and the text of each."""
    low = ascii_lower(raw)
    starts, ends, doc = spans(low, offsets)
    names = hashed(low, starts, ends)
    texts = len(offsets) - 1
    at = np.searchsorted(doc, np.arange(texts), "right")
    return np.insert(names, at, END), np.insert(doc, at, np.arange(texts))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The id, the role (0 scored only, 1 trained on, 2 trained on but left out at first), the text."""
    k = F.col(f"`{key}`")
    left_out = F.pmod(F.xxhash64(F.coalesce(k.cast("string"), F.lit("")), F.lit(3)), F.lit(LEFT_OUT)) == 0
    role = F.when(fold_of(key, FOLDS) == 0, 0).when(left_out, 2).otherwise(1)
    return docs.select(k.alias("doc_id"), role.alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def _batch(fields: dict[str, pa.DataType], size: int, **columns) -> pa.RecordBatch:
    """A record batch of these fields; those without values are null."""
    arrays = []
    for name, kind in fields.items():
        x = columns.get(name)
        arrays.append(pa.nulls(size, kind) if x is None else x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind))
    return pa.RecordBatch.from_arrays(arrays, names=list(fields))


#: Types of packed columns. A block: word numbers plus one (0 for rare words), tokens and role of each document.
#: What it asks: steps of sorted pairs, their counts, and counts left out. An answer: counts.
BLOCK_KINDS = (np.uint32, np.uint32, np.uint8)
ASKED_KINDS = (np.uint64, np.uint32, np.uint32)
ANSWER_KINDS = (np.uint32,)


def pack(columns: list[np.ndarray], kinds: tuple) -> bytes:
    """Columns of numbers, compressed byte plane by byte plane."""
    columns = [np.ascontiguousarray(c, k) for c, k in zip(columns, kinds, strict=True)]
    head = np.array([len(columns), *map(len, columns)], np.int64).tobytes()
    body = head + b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return len(body).to_bytes(8, "little") + pa.compress(body, codec="zstd", asbytes=True)


def unpack(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    body = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), np.uint8)
    sizes, at, out = body[8 : 8 * (len(kinds) + 1)].view(np.int64), 8 * (len(kinds) + 1), []
    for size, kind in zip(sizes.tolist(), map(np.dtype, kinds), strict=True):
        wide = size * kind.itemsize
        out.append(np.ascontiguousarray(body[at : at + wide].reshape(kind.itemsize, size).T).view(kind).ravel())
        at += wide
    return out


def by_partition(pair: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, partitions that have pairs, bounds): pairs sorted by partition and value."""
    part = (mix(pair) % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((pair, part))
    full, start = np.unique(part[order], return_index=True)
    return order, full, np.append(start, len(pair))


# Words -------------------------------------------------------------------------------------------


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, n, left_out): how often each word occurs in training documents, and in those left out."""

    def make():
        held: list[list[np.ndarray]] = []

        def merged():
            names, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return [names, *[np.bincount(where, np.concatenate([h[i] for h in held]), len(names)).astype(np.int64) for i in (1, 2)]]

        def batch(h):
            return pa.RecordBatch.from_arrays([pa.array(h[0].view(np.int64)), pa.array(h[1]), pa.array(h[2])], names=["word", "n", "left_out"])

        def fn(raw, offsets, part):
            names, doc = tokens(raw, offsets)
            role = part.column(0).to_numpy()[doc]
            word, where = np.unique(names[role > 0], return_inverse=True)
            held.append([word, np.bincount(where, minlength=len(word)), np.bincount(where, role[role > 0] == 2, len(word)).astype(np.int64)])
            if sum(len(h[0]) for h in held) > HELD:
                held[:] = [merged()]
                if len(held[0][0]) > HELD // 2:
                    return batch(held.pop())

        fn.flush = lambda: [batch(merged())] if held else []
        return fn

    kinds = T.StructType([T.StructField(c, T.LongType()) for c in ("word", "n", "left_out")])
    found = expand_text(rows.filter("role > 0"), "text", ["role"], make, kinds)
    return found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("left_out").alias("left_out"))


class Vocabulary:
    """The numbered words: names in order with their ranks, and counts by rank, with and without what is left out."""

    def __init__(self, word: np.ndarray, n: np.ndarray, left_out: np.ndarray):
        word = word.view(np.uint64)
        order = np.lexsort((word, -n))
        kind = np.uint32 if not len(n) or n.max() < 2**32 else np.int64
        self.n, self.main = n[order].astype(kind), (n - left_out)[order].astype(kind)
        ranked = word[order]
        at = np.argsort(ranked)
        self.word, self.rank = ranked[at], at.astype(np.int32)
        self.end = int(self.numbers(np.array([END]))[0])

    def numbers(self, names: np.ndarray) -> np.ndarray:
        """Ranks of names; -1 where a word has no number."""
        if not len(self.word):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.word, names), len(self.word) - 1)
        return np.where(self.word[at] == names, self.rank[at], -1)


def most_frequent(words: DataFrame, limit: int) -> DataFrame:
    """The most frequent words, ``limit`` at most: whole eighths of an octave of counts from the top."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    bins = words.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("level")).collect()  # 8 rows an octave
    least, held = float("inf"), 0
    for r in bins:
        held += r["words"]
        if held > limit:
            break
        least = float(r["level"])
    return words.filter(level >= F.lit(least))


def fetched(df: DataFrame, key: str, pieces: int = 16) -> list[np.ndarray]:
    """The columns of a bounded table on the driver, fetched in pieces."""
    got = [df.filter(F.pmod(F.xxhash64(key), F.lit(pieces)) == k).toArrow() for k in range(pieces)]
    return [np.concatenate([p.column(i).to_numpy() for p in got]) for i in range(len(df.columns))]


def bucket(n: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else 1 + floor(log2(n))."""
    return np.where(n > 0, np.minimum(np.frexp(n.astype(float))[1], BUCKETS - 1), 0)


def mixture(weights: np.ndarray, both, before, after, total: int, words: int) -> np.ndarray:
    w = weights[bucket(before)]
    return w[:, 0] * both / np.maximum(before, 1) + w[:, 1] * after / max(total, 1) + w[:, 2] / (words + 1)


def _grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): rows sorted by the keys, the last one first, and where a new combination starts."""
    order = np.lexsort(keys)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, np.flatnonzero(new)


# Blocks ------------------------------------------------------------------------------------------

_LONG = pa.int64()
#: What a task makes of texts: rows of documents (row, n_tokens, ...), blocks (block, cell), and pairs with a rare word (before, after, ...; counts of the other word).
FOUND = {"block": _LONG, "cell": pa.binary(), "row": _LONG, "n_tokens": _LONG, "n_known": _LONG, "base": pa.float64(), "before": _LONG, "after": _LONG, "n": _LONG, "role": pa.int32()} | {f"{a}_{b}": _LONG for a in ("before", "after") for b in ("n", "main")}
_FOUND = "block long, cell binary, row long, n_tokens long, n_known long, base double, before long, after long, n long, role int, before_n long, before_main long, after_n long, after_main long"


def _known(number: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Counts of numbered words, null for the others."""
    if not len(counts):
        return pa.nulls(len(number), _LONG)
    return pa.array(counts[np.maximum(number, 0)].astype(np.int64), _LONG, mask=number < 0)


def blocks(rows: DataFrame, vocabulary, total: int, known: int) -> DataFrame:
    """FOUND and doc_id. A document's row number is unique; a block bears that of its first document and numbers on."""

    def make():
        v = vocabulary.value
        held, row = [], TaskContext.get().partitionId() << 33

        def block(fields):
            number, size, role = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            return _batch(fields, 1, block=[row - len(size)], cell=[pack([number + 1, size, role], BLOCK_KINDS)])

        def fn(raw, offsets, piece):
            nonlocal row
            texts, fields = len(piece), FOUND | {"doc_id": piece.schema.field(0).type}
            names, doc = tokens(raw, offsets)
            cut, role = np.searchsorted(doc, np.arange(texts + 1)), piece.column(1).to_numpy()
            word, where = np.unique(names, return_inverse=True)
            number = v.numbers(word)[where]
            n = np.where(number >= 0, v.n[number] if len(v.n) else 0, 0).astype(np.int64)
            base = np.where(number >= 0, np.log10((n + 0.1) / (total + 0.1 * (known + 1))), 0.0)
            numbers, row = row + np.arange(texts), row + texts
            out = [_batch(fields, texts, doc_id=piece.column(0), row=numbers, n_tokens=np.diff(cut), n_known=per_text((n > 0).astype(np.int64), cut), base=per_text(base, cut))]
            before, before_number = np.roll(names, 1), np.roll(number, 1)
            before[cut[:-1]], before_number[cut[:-1]] = END, v.end
            rare = np.flatnonzero((number < 0) | (before_number < 0))
            if len(rare):
                order, at = _grouped(names[rare], before[rare], doc[rare])
                some = rare[order[at]]
                columns = {f"{k}_{c}": _known(x[some], getattr(v, c)) for k, x in (("before", before_number), ("after", number)) for c in ("n", "main")}
                out.append(_batch(fields, len(some), row=numbers[doc[some]], role=role[doc[some]], before=before[some].view(np.int64), after=names[some].view(np.int64), n=np.diff(np.append(at, len(rare))), **columns))
            held.append((number.astype(np.int32), np.diff(cut), role))
            if sum(len(h[0]) for h in held) >= BLOCK:
                out.append(block(fields))
            fn.flush = lambda: [block(fields)] if held else []
            return pa.Table.from_batches(out).combine_chunks().to_batches()[0]

        return fn

    schema = T._parse_datatype_string(_FOUND).add(T.StructField("doc_id", rows.schema["doc_id"].dataType))
    return expand_text(rows, "text", ["doc_id", "role"], make, schema)


class Block:
    """The pairs of numbered words of a block: distinct ones in the order of partitions and values, and the place of each token's pair among them."""

    def __init__(self, cell: bytes, end: int, parts: int):
        number, self.size, self.role = unpack(cell, BLOCK_KINDS)
        number = number.astype(np.int64) - 1
        before = np.roll(number, 1)
        before[np.cumsum(self.size, dtype=np.int64) - self.size] = end
        self.use = np.flatnonzero((number >= 0) & (before >= 0))
        pair, where = np.unique(before[self.use].astype(np.uint64) << np.uint64(32) | number[self.use].astype(np.uint64), return_inverse=True)
        order, self.full, self.cut = by_partition(pair, parts)
        self.pair, place = pair[order], np.empty(len(pair), np.int64)
        place[order] = np.arange(len(pair))
        self.place = place[where]

    def of_tokens(self, each: np.ndarray) -> np.ndarray:
        """A value of each document for all its tokens with numbered pairs."""
        return np.repeat(each, self.size)[self.use]


def asked(found: DataFrame, vocabulary, parts: int) -> DataFrame:
    """(part, block, cell): the distinct pairs of each block, with their counts in its training documents."""

    def run(batches):
        end = vocabulary.value.end
        for batch in batches:
            for block, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = Block(cell.as_py(), end, parts)
                role, size = b.of_tokens(b.role), len(b.pair)
                n, left = (np.bincount(b.place, x, size) for x in (role > 0, role == 2))
                made = [pack([np.diff(b.pair[lo:hi], prepend=np.uint64(0)), n[lo:hi], left[lo:hi]], ASKED_KINDS) for lo, hi in zip(b.cut[:-1], b.cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(b.full.astype(np.int32)), pa.array(np.full(len(made), block)), pa.array(made, pa.binary())], names=["part", "block", "cell"])

    return found.filter("cell is not null").select("block", "cell").mapInArrow(run, "part int, block long, cell binary")


def _runs(batches: Iterator[pa.RecordBatch], key: int):
    """Rows (part, block, cell) sorted by a column: the key and its rows, one key after the other."""
    now, held = None, []
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(2)], batch.column(2), strict=True):
            if held and row[key] != now:
                yield now, held
                held = []
            now = row[key]
            held.append((*row[:2], row[2].as_py()))
    if held:
        yield now, held


#: Answers to blocks (part, block, cell), and events: what happened to the left-out pairs.
ANSWERS = {"part": pa.int32(), "block": _LONG, "cell": pa.binary()} | {k: _LONG for k in ("bucket", "both", "before", "after", "n")}
_ANSWERS = "part int, block long, cell binary, bucket long, both long, before long, after long, n long"


def answers(asks: DataFrame, vocabulary, tasks: int) -> DataFrame:
    """ANSWERS: counts of all training documents in the order in which a block asks, and (bucket, both, before, after, n) events."""

    def run(batches):
        v = vocabulary.value
        for part, rows in _runs(batches, 0):
            columns = list(zip(*[unpack(x, ASKED_KINDS) for _, _, x in rows], strict=True))
            ends = np.cumsum([0, *map(len, columns[0])])
            pair, at = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint64) for x in columns[0]]), return_inverse=True)
            n, left = (np.bincount(at, np.concatenate(c), len(pair)).astype(np.int64) for c in columns[1:])
            back = n[at]
            yield _batch(ANSWERS, len(rows), part=np.full(len(rows), part, np.int32), block=[b for _, b, _ in rows], cell=[pack([back[lo:hi]], ANSWER_KINDS) for lo, hi in zip(ends[:-1], ends[1:], strict=True)])
            use = left > 0
            both = (n - left)[use]
            before, after = (v.main[x.astype(np.int64)].astype(np.int64) for x in (pair[use] >> np.uint64(32), pair[use] & np.uint64(2**32 - 1)))
            before = np.where(both > 0, before, 2 ** np.maximum(bucket(before) - 1, 0) * (before > 0))  # without the pair, only its bucket matters
            order, at = _grouped(after, before, both)
            if len(at):
                some = order[at]
                yield _batch(ANSWERS, len(at), bucket=bucket(before[some]), both=both[some], before=before[some], after=after[some], n=np.add.reduceat(left[use][order], at))

    return asks.repartition(tasks, F.pmod("part", F.lit(tasks))).sortWithinPartitions("part").mapInArrow(run, _ANSWERS)


def learn_weights(events: DataFrame, total: int, words: int, rounds: int = ROUNDS) -> np.ndarray:
    """BUCKETS x 3 weights of the bigram, unigram and uniform estimates, by expectation-maximisation.

    ``events`` (bucket, both, before, after, n) may repeat. One grouped sum a round; only three sums a bucket reach
    the driver. Each weight has one event as prior.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    two = F.when(F.col("before") > 0, F.col("both") / F.greatest(F.col("before"), F.lit(1))).otherwise(0.0)
    one = F.col("after") / F.lit(float(max(total, 1)))
    for _ in range(rounds):
        w = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, k]]), F.col("bucket").cast("int") + 1) for k in range(3)]
        parts = [w[0] * two, w[1] * one, w[2] / F.lit(float(words + 1))]
        whole = parts[0] + parts[1] + parts[2]
        got = events.groupBy("bucket").agg(*[F.sum(F.col("n") * p / whole).alias(f"s{k}") for k, p in enumerate(parts)]).collect()
        new = np.ones((BUCKETS, 3))
        for r in got:
            new[r["bucket"]] += [r["s0"], r["s1"], r["s2"]]
        new[0, 0] = 0.0  # an unseen context has no bigram estimate
        new[:, 1] *= total > 0  # nor have no documents a unigram estimate
        new /= new.sum(axis=1, keepdims=True)
        if np.abs(new - weights).max() < 1e-4:
            return new
        weights = new
    return weights


# Pairs with a rare word --------------------------------------------------------------------------


def _bucket(c: str):
    return F.when(F.col(c) > 0, F.least(F.floor(F.log2(F.col(c).cast("double")) + 1e-12).cast("int") + 1, F.lit(BUCKETS - 1))).otherwise(0)


def rare_pairs(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Each pair with a rare word: how often it occurs in training documents (n, and left_out), and the counts n and main of both words.

    A pair brings the counts of the word that is numbered; the other one is rare, so that no key of these joins has many
    rows. Pairs whose count is known are spread by the other word.
    """
    in_role = lambda *r: F.sum(F.when(F.col("role").isin(*r), F.col("n")).otherwise(0))
    given = [f"{a}_{b}" for a in ("before", "after") for b in ("n", "main")]
    pairs = rows.groupBy("before", "after").agg(in_role(1, 2).alias("n"), in_role(2).alias("left_out"), *[F.max(c).alias(c) for c in given])
    pairs = pairs.withColumn("after_is_rare", F.col("after_n").isNull())
    own = words.select(F.col("word").alias("__word"), F.col("n").alias("__n"), (F.col("n") - F.col("left_out")).alias("__main"))
    for side, other in (("before", "after"), ("after", "before")):
        meets = F.when(F.col(f"{side}_n").isNull(), F.col(side)).otherwise(F.col(other))
        pairs = pairs.withColumn("__key", meets).join(own, F.col("__key") == F.col("__word"), "left")
        pairs = pairs.withColumns({f"{side}_{c}": F.coalesce(f"{side}_{c}", F.col(f"__{c}"), F.lit(0)) for c in ("n", "main")}).drop("__key", "__word", "__n", "__main")
    return pairs


def rare_events(pairs: DataFrame) -> DataFrame:
    met = pairs.filter("left_out > 0")
    return met.select(_bucket("before_main").cast("long").alias("bucket"), (F.col("n") - F.col("left_out")).alias("both"), F.col("before_main").alias("before"), F.col("after_main").alias("after"), F.col("left_out").alias("n"))


def rare_scores(rows: DataFrame, pairs: DataFrame, weights: np.ndarray, total: int, known: int) -> DataFrame:
    """(row, score, base, known): sums over a document's pairs with a rare word; base and known of rare words only."""
    w = [F.element_at(F.array(*[F.lit(float(x)) for x in weights[:, k]]), _bucket("before_n") + 1) for k in range(3)]
    chance = w[0] * F.col("n") / F.greatest(F.col("before_n"), F.lit(1)) + w[1] * F.col("after_n") / F.lit(float(max(total, 1))) + w[2] / F.lit(float(known + 1))
    base = F.log10((F.col("after_n") + 0.1) / F.lit(total + 0.1 * (known + 1)))
    own = lambda x: F.when(F.col("after_is_rare"), x).otherwise(F.lit(0))
    scored = pairs.select("before", "after", F.log10(chance).alias("logs"), own(base).alias("base"), own((F.col("after_n") > 0).cast("long")).alias("known"))
    met = rows.select("row", "before", "after", F.col("n").alias("many")).join(scored, ["before", "after"])
    return met.select("row", *[(F.col(c) * F.col("many")).alias(d) for c, d in (("logs", "score"), ("base", "base"), ("known", "known"))])


# Scores of documents -----------------------------------------------------------------------------


def block_scores(cells: DataFrame, vocabulary, weights: np.ndarray, parts: int, tasks: int, total: int, known: int) -> DataFrame:
    """(row, score) of every document over its pairs of numbered words. ``cells`` (part, block, cell): blocks, without a part, and answers."""

    def run(batches):
        v = vocabulary.value
        for block, rows in _runs(batches, 1):
            b = Block(rows[0][2], v.end, parts)
            both = np.concatenate([np.zeros(0, np.uint32), *[unpack(x, ANSWER_KINDS)[0] for _, _, x in rows[1:]]])
            before, after = (v.n[x.astype(np.int64)].astype(np.int64) for x in (b.pair >> np.uint64(32), b.pair & np.uint64(2**32 - 1)))
            logs = np.log10(mixture(weights, both, before, after, total, known))
            doc = b.of_tokens(np.arange(len(b.size)))
            yield pa.RecordBatch.from_arrays([pa.array(block + np.arange(len(b.size))), pa.array(np.bincount(doc, logs[b.place], len(b.size)), pa.float64())], names=["row", "score"])

    return cells.repartition(tasks, "block").sortWithinPartitions("block", "part").mapInArrow(run, "row long, score double")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", word_limit: int = WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``word_limit`` bounds the words that are sent to every task; scores don't depend on it.
    """
    rows = _rows(docs, key, text)
    words = durable(word_counts(rows), "words")
    known, total, main = words.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.col("n") - F.col("left_out"))).first()
    total, main = int(total or 0), int(main or 0)
    parts = max(8, -(-total // PAIRS))
    tasks = max(8, -(-parts // GROUP))
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(*fetched(most_frequent(words, word_limit), "word")))
    found = durable(blocks(rows, vocabulary, total, known), "blocks")
    back = durable(answers(asked(found, vocabulary, parts), vocabulary, tasks), "answers")
    rare_rows = found.filter("before is not null")
    rare = durable(rare_pairs(rare_rows, words), "rare")
    events = back.filter("bucket is not null").select("bucket", "both", "before", "after", "n").unionByName(rare_events(rare))
    weights = learn_weights(events, main, known)
    cells = found.filter("cell is not null").select(F.lit(None).cast("int").alias("part"), "block", "cell").unionByName(back.filter("cell is not null").select("part", "block", "cell"))
    scores = block_scores(cells, vocabulary, weights, parts, tasks, total, known).select("row", "score", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"))
    scores = scores.unionByName(rare_scores(rare_rows, rare, weights, total, known))
    scores = scores.groupBy("row").agg(*[F.sum(c).alias(f"more_{c}") for c in ("score", "base", "known")])
    out = found.filter("n_tokens is not null").join(scores, "row", "left").fillna(0, [f"more_{c}" for c in ("score", "base", "known")])
    both = lambda a, b: F.col(a) + F.col(f"more_{b}")
    return out.select("doc_id", (fold_of("doc_id", FOLDS) == 0).alias("held_out"), "n_tokens", both("n_known", "known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), both("base", "base").alias("base_score"), F.col("more_score").alias("score"))
