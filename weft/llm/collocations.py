"""Phrase collocation mining with pivot partitioning, after MG-FSM.

Words are counted by language first. Every phrase belongs to its rarest word, its pivot (of several occurrences the
first). Around each occurrence of a frequent word, the text is rewritten to the fragment that the word can own: at most
``longest - 1`` words on each side, up to the first word that is rarer (or infrequent, or the same word on the left). Fragments
travel to their pivot's partition, where they are mined locally: all phrases of a fragment that hold the pivot are counted, and
no other. A pivot with more than ``SPLIT`` occurrences is dealt in salts by fragment, and its partial counts are summed; of all
others a partition's counts are final and only frequent phrases leave it.

Phrases are then scored at each cut by a product of counts in exact decimals, and phrases that a longer one explains are
dropped: as counts fall from a phrase to its extensions, the two extensions by one word tell.

Words travel as numbers. The ``HOT`` most frequent ones are numbered 0, 1, ... by a table that goes to every task (12 bytes
a word). Any other keeps its 64-bit name; how rare it is tells a table of ``CELLS`` cells in four rows, each with the highest
count of the words that fall into it, of which the least of four holds. This estimate can be too high, which makes a fragment longer
or shorter than it had to be, but never changes a count, because every task orders the words alike. Names are unique: a seed
under which two words share one is not used.

Defined results: a null or empty text has no words; a null language is ``und``; rows that repeat, and ids, don't matter: each row
counts; texts of any length count whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounds, durable, slices, text_bytes
from .words import ascii_lower, hashed, mix, spans

HOT = 1 << 20
CELLS = 1 << 21
_ROWS = 4
#: Occurrences of a pivot that one task mines.
SPLIT = 1 << 17
#: Text bytes whose fragments are combined before the shuffle.
COMBINE_BYTES = 1 << 23
_POSITIONS = 1 << 19
#: Fragments that are mined together.
_MINED = 1 << 17
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_INSIDE = ~_ENDS
_INSIDE[[0x20, 0x09]] = False
_NONE = np.int64(np.iinfo(np.int64).min)


def words_of(batch: pa.RecordBatch, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, text numbers, piece numbers, names) of the words of a batch (lang, text)."""
    raw, offsets = text_bytes(batch.column(1))
    low = ascii_lower(raw)
    starts, ends, doc = spans(low, offsets, _INSIDE[low])
    piece = np.cumsum(_ENDS[low])[starts] + doc if len(starts) else doc
    lang = batch.column(0).dictionary_encode()
    own = np.array([xxhash.xxh64_intdigest(x.as_py().encode(), seed) for x in lang.dictionary], np.uint64)
    names = mix(hashed(low, starts, ends, seed) ^ own[lang.indices.to_numpy()][doc]) if len(starts) else np.zeros(0, np.uint64)
    return low, starts, ends, doc, piece, (names | np.uint64(1 << 63)).view(np.int64)


def _source(df: DataFrame, text: str, lang: str) -> DataFrame:
    return df.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))


def word_counts(df: DataFrame, text: str, lang: str, seed: int) -> DataFrame:
    """(lang, word, name, n) of all words; a slice of texts is added up before the shuffle."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1, COMBINE_BYTES):
                low, starts, ends, doc, _, names = words_of(batch, seed)
                if not len(names):
                    continue
                _, first, inverse, n = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
                body, other = low.tobytes(), hashed(low, starts, ends, seed + 1)
                if (odd := np.flatnonzero(other != other[first][inverse])).size:  # shares its name with another word here
                    np.subtract.at(n, inverse[odd], 1)
                    first, n = np.append(first, odd), np.append(n, np.ones(len(odd), n.dtype))
                found = pa.array([body[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[first])), found, pa.array(names[first]), pa.array(n.astype(np.int64))], names=["lang", "word", "name", "n"])

    counted = _source(df, text, lang).mapInArrow(run, "lang string, word string, name long, n long")
    return counted.groupBy("lang", "word", "name").agg(F.sum("n").alias("n"))


def named(df: DataFrame, text: str, lang: str) -> tuple[DataFrame, int]:
    """Word counts under a seed for which no two words share a name."""
    seed = 0
    while True:
        counted = durable(word_counts(df, text, lang, seed), "words")
        if not counted.groupBy("name").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").limit(1).count():
            return counted, seed
        seed += 1


class Rarity:
    """Numbers of the hot words and an order of all frequent words; of bounded size."""

    def __init__(self, names: np.ndarray, counts: np.ndarray, cells: np.ndarray | None):
        order = np.argsort(names)
        self.names, self.counts, self.cells = names[order], counts[order], cells
        self.place = np.empty(len(names), np.int64)
        self.place[np.lexsort((self.names, self.counts))] = np.arange(len(names))

    def look(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, key, estimated count): rarer words have smaller keys, infrequent ones -1."""
        if not len(self.names):
            at, hot = np.zeros(len(names), np.int64), np.zeros(len(names), bool)
        else:
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            hot = self.names[at] == names
        if len(self.names):
            count = np.where(hot, self.counts[at], 0)
            key = np.where(hot, (1 << 62) + self.place[at], -1)
        else:
            count, key = np.zeros(len(names), np.int64), np.full(len(names), -1, np.int64)
        if self.cells is not None and not hot.all():
            cold = np.flatnonzero(~hot)
            guess = np.take_along_axis(self.cells, cells_of(names[cold], self.cells.shape[1]), 1).min(axis=0)
            count[cold] = guess
            key[cold] = np.where(guess > 0, np.minimum(guess, (1 << 30) - 1) << 31 | names[cold] & 0x7FFFFFFF, -1)
        return np.where(hot, at, names), key, count


def cells_of(names: np.ndarray, cells: int) -> np.ndarray:
    h = mix(names.view(np.uint64))
    out = []
    for _ in range(_ROWS):
        out.append((h % np.uint64(cells)).astype(np.int64))
        h = mix(h + np.uint64(0x9E3779B97F4A7C15))
    return np.array(out)


def rarity(frequent: DataFrame, hot: int, cells: int) -> Rarity:
    """At most ``hot`` names and counts, and four rows of ``cells`` cells, come to the driver."""
    level = F.floor(F.log2(F.col("n")) * 16).cast("int")
    steps = frequent.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("level")).collect()  # 16 rows a power of two
    least, held = None, 0
    for row in steps:
        if held + row["k"] > hot:
            break
        least, held = row["level"], held + row["k"]
    top = frequent.filter(level >= least) if least is not None else frequent.limit(0)
    rows = top.select("name", "n").toArrow()
    table = None
    if held < sum(r["k"] for r in steps):

        def run(batches):
            for batch in batches:
                if len(batch):
                    at = cells_of(batch.column(0).to_numpy(), cells)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(_ROWS), len(batch))), pa.array(at.ravel()), pa.array(np.tile(batch.column(1).to_numpy(), _ROWS))], names=["row", "cell", "n"])

        cold = frequent.filter(level < least) if least is not None else frequent
        filled = cold.select("name", "n").mapInArrow(run, "row long, cell long, n long").groupBy("row", "cell").agg(F.max("n").alias("n")).toArrow()
        table = np.zeros((_ROWS, cells), np.int64)
        table[filled.column("row").to_numpy(), filled.column("cell").to_numpy()] = filled.column("n").to_numpy()
    return Rarity(rows.column("name").to_numpy().astype(np.int64), rows.column("n").to_numpy().astype(np.int64), table)


def windows(number: np.ndarray, key: np.ndarray, piece: np.ndarray, reach: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, left, right): how far the fragments of the frequent words at places lo to hi reach."""
    at = lo + np.flatnonzero(key[lo:hi] >= 0)
    left, right = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for step in range(1, reach + 1):
        to = np.maximum(at - step, 0)
        left += (left == step - 1) & (at >= step) & (piece[to] == piece[at]) & (key[to] > key[at])
        to = np.minimum(at + step, len(key) - 1)
        right += (right == step - 1) & (at + step < len(key)) & (piece[to] == piece[at]) & (key[to] >= key[at])
    some = (left + right) > 0
    return at[some], left[some], right[some]


def combined(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows once, with the sum of their counts, and their hashes; the rows are compared, not only the hashes."""
    h = np.zeros(len(rows), np.uint64)
    if not len(rows):
        return rows, counts, h
    for c in range(rows.shape[1]):
        h = mix(h * np.uint64(0xA24BAED4963EE407) + rows[:, c].view(np.uint64))
    order = np.argsort(h)
    rows, counts, h = rows[order], counts[order], h[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    first = np.flatnonzero(new)
    return rows[first], np.add.reduceat(counts, first), h[first]


def packed(rows: np.ndarray, reach: int) -> pa.Array:
    """Fragments as bytes: words on the left, then 4 bytes a word, or 8 where a word isn't hot. Columns of a row: left, words."""
    words = rows[:, 1:]
    used = words != _NONE
    wide = ((words < 0) & used).any(axis=1)
    size = used.sum(axis=1)
    out = np.empty(len(rows), object)
    for is_wide, kind in ((False, np.int32), (True, np.int64)):
        at = np.flatnonzero(wide == is_wide)
        for n in np.unique(size[at]).tolist():
            own = at[size[at] == n]
            # the fragment is shifted to start in the first column
            part = np.ascontiguousarray(words[own][:, :n].astype(kind))
            head = (rows[own, 0] + (16 if is_wide else 0)).astype(np.uint8)[:, None]
            body = np.concatenate([head, part.view(np.uint8).reshape(len(own), -1)], axis=1)
            out[own] = np.ascontiguousarray(body).view(f"V{body.shape[1]}").ravel().tolist()
    return pa.array(out.tolist(), pa.binary())


def unpacked(column: pa.Array, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, words with the pivot at place longest - 1) of packed fragments."""
    reach = longest - 1
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)
    head, size = raw[offsets[:-1]], np.diff(offsets) - 1
    wide, left = head >= 16, (head & 15).astype(np.int64)
    out = np.full((len(column), 2 * reach + 1), _NONE)
    count = np.where(wide, size // 8, size // 4)
    for is_wide, kind in ((False, np.int32), (True, np.int64)):
        for n in np.unique(count[wide == is_wide]).tolist():
            own = np.flatnonzero((wide == is_wide) & (count == n))
            width = n * np.dtype(kind).itemsize
            part = raw[offsets[own][:, None] + 1 + np.arange(width)]
            part = np.ascontiguousarray(part).view(kind).reshape(len(own), n).astype(np.int64)
            out[own[:, None], reach - left[own][:, None] + np.arange(n)] = part
    return left, count - 1 - left, out


def fragments(df: DataFrame, text: str, lang: str, order, seed: int, longest: int, split: int) -> DataFrame:
    """(pivot, salt, fragment, n); salt -1 says that the pivot has one."""
    reach = longest - 1

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 1, COMBINE_BYTES):
                *_, piece, names = words_of(batch, seed)
                number, key, count = order.value.look(names)
                for lo in range(0, len(names), _POSITIONS):
                    at, left, right = windows(number, key, piece, reach, lo, min(lo + _POSITIONS, len(names)))
                    if not len(at):
                        continue
                    step = np.arange(2 * reach + 1)
                    to = (at - left)[:, None] + step
                    rows = np.full((len(at), 2 * reach + 2), _NONE)
                    rows[:, 0] = left
                    inside = step <= (left + right)[:, None]
                    rows[:, 1:][inside] = number[np.minimum(to, len(number) - 1)][inside]
                    keys = np.column_stack([number[at], np.maximum(-(-count[at] // split), 1), rows])
                    keys, n, h = combined(keys, np.ones(len(at), np.int64))
                    salt = np.where(keys[:, 1] > 1, (h % keys[:, 1].astype(np.uint64)).astype(np.int64), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(salt.astype(np.int32)), packed(keys[:, 2:], reach), pa.array(n)], names=["pivot", "salt", "fragment", "n"])

    return _source(df, text, lang).mapInArrow(run, "pivot long, salt int, fragment binary, n long")


def mined(left: np.ndarray, right: np.ndarray, words: np.ndarray, n: np.ndarray, single: np.ndarray, longest: int, support: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of 2 to ``longest`` words that hold the pivot, with counts; infrequent ones only of salted pivots."""
    reach = longest - 1
    rows, counts = [], []
    for size in range(2, longest + 1):
        for before in range(size):
            own = np.flatnonzero((left >= before) & (right >= size - 1 - before))
            if not len(own):
                continue
            part = np.full((len(own), longest + 1), _NONE)
            part[:, 0] = single[own]
            part[:, 1 : size + 1] = words[own, reach - before : reach - before + size]
            rows.append(part)
            counts.append(n[own])
    if not rows:
        return np.zeros((0, longest), np.int64), np.zeros(0, np.int64)
    rows, counts, _ = combined(np.concatenate(rows), np.concatenate(counts))
    keep = (rows[:, 0] == 0) | (counts >= support)
    return rows[keep, 1:], counts[keep]


def frequent_phrases(found: DataFrame, order, longest: int, support: int) -> DataFrame:
    """(gram, a): names of the words, and occurrences, of phrases with at least ``support`` of them."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0
        for batch in batches:
            if len(batch):
                held.append(batch)
                size += len(batch)
            if size >= _MINED:
                ready = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cut = int(bounds(ready, 2)[-2])
                if cut:
                    yield from local(ready.slice(0, cut))
                held, size = [ready.slice(cut)], len(ready) - cut
        if size:
            yield from local(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def local(batch):
        single = (batch.column(1).to_numpy() < 0).astype(np.int64)
        rows, counts = mined(*unpacked(batch.column(2), longest), batch.column(3).to_numpy(), single, longest, support)
        if not len(rows):
            return
        used = rows != _NONE
        flat = rows[used]
        names = order.value.names
        hot = flat >= 0
        flat[hot] = names[flat[hot]]
        ends = np.append(0, np.cumsum(used.sum(axis=1))).astype(np.int32)
        for lo in range(0, len(rows), 1 << 16):
            hi = min(lo + (1 << 16), len(rows))
            gram = pa.ListArray.from_arrays(pa.array(ends[lo : hi + 1] - ends[lo], pa.int32()), pa.array(flat[ends[lo] : ends[hi]]))
            yield pa.RecordBatch.from_arrays([gram, pa.array(counts[lo:hi])], names=["gram", "a"])

    dealt = found.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt")
    return dealt.mapInArrow(run, "gram array<long>, a long").groupBy("gram").agg(F.sum("a").alias("a")).filter(F.col("a") >= support)


def unexplained(grams: DataFrame, percent: int) -> DataFrame:
    """Phrases that aren't inside a longer one with at least ``percent`` of their count.

    An extension by one word inside that longer phrase has at least its count, so that these are enough.
    """
    n = F.size("gram")
    inner = F.array(F.slice("gram", F.lit(1), n - 1), F.slice("gram", F.lit(2), n - 1))
    longer = grams.filter(n > 2).select(F.explode(inner).alias("gram"), F.col("a").alias("longer")).groupBy("gram").agg(F.max("longer").alias("longer"))
    return grams.join(longer, "gram", "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def mine(df: DataFrame, text: str = "text", lang: str = "lang", support: int = 100, longest: int = 5, percent: int = 100, top: int = 2000, hot: int = HOT, cells: int = CELLS, split: int = SPLIT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by their lowest-scoring cut."""
    context = df.sparkSession.sparkContext
    counted, seed = named(df, text, lang)
    frequent = counted.filter(F.col("n") >= support)
    order = context.broadcast(rarity(frequent, hot, cells))
    grams = durable(frequent_phrases(fragments(df, text, lang, order, seed, longest, split), order, longest, support), "phrases")
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    parts = grams.union(frequent.select(F.array("name"), "n"))
    cut = unexplained(grams, percent).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("gram") - 1)))
    cut = cut.withColumn("first", F.slice("gram", F.lit(1), F.col("k"))).withColumn("rest", F.slice("gram", F.col("k") + 1, F.size("gram")))
    cut = cut.join(parts.select(F.col("gram").alias("first"), F.col("a").alias("l")), "first").join(parts.select(F.col("gram").alias("rest"), F.col("a").alias("r")), "rest")
    words = frequent.select("name", "word", "lang")
    cut = cut.join(words.select(F.col("name").alias("head"), "lang"), F.element_at("gram", 1) == F.col("head")).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    cut = cut.withColumn("over", exact("a") * exact("n") * 1000).withColumn("under", exact("l") * exact("r")).withColumn("score", F.expr("`over` div `under`"))
    lowest = cut.groupBy("gram", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m")).select("gram", "lang", "a", "n", "m.score", "m.l", "m.r")
    spelled = lowest.select("*", F.posexplode("gram").alias("place", "name")).join(words.drop("lang"), "name")
    spelled = spelled.groupBy("gram", "lang", "a", "n", "score", "l", "r").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("words"))
    spelled = spelled.withColumn("phrase", F.concat_ws(" ", F.transform("words", lambda w: w["word"])))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT lang, row_number() OVER () AS piece, body FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS body FROM documents)),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(body, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, len, ws[i : i + len - 1] AS gram FROM (SELECT lang, ws, len, unnest(range(1, len(ws) - len + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS len) WHERE len(ws) >= len)),
f AS MATERIALIZED (SELECT lang, gram, len, count(*)::BIGINT AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
x AS (SELECT lang, gram, max(a) AS longer FROM (SELECT lang, gram[1 : len - 1] AS gram, a FROM f WHERE len > 2 UNION ALL SELECT lang, gram[2 : len] AS gram, a FROM f WHERE len > 2) GROUP BY ALL),
c AS (SELECT f.*, unnest(range(1, len)) AS k FROM f LEFT JOIN x USING (lang, gram) WHERE len > 1 AND (longer IS NULL OR longer < a)),
s AS (SELECT c.lang, c.gram, c.a, k, u.a AS l, v.a AS r, n, ((1000::HUGEINT * c.a * n) // (u.a::HUGEINT * v.a))::BIGINT AS score
      FROM c JOIN t ON t.lang = c.lang JOIN f u ON u.lang = c.lang AND u.gram = c.gram[1 : k] JOIN f v ON v.lang = c.lang AND v.gram = c.gram[k + 1 : c.len]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) AS low FROM s),
r AS (SELECT lang, array_to_string(gram, ' ') AS phrase, a, l, r, n, score FROM b WHERE low = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM r)
SELECT * FROM o WHERE rank <= 2000
"""
