"""Toxicity of texts after noisy-channel deobfuscation.

Tokens that look disguised (digits or signs among letters, a letter three times in a row, letters
spaced out) become a lattice: each character may stand for itself or for letters that it resembles, a run
of a letter may stand for one or two, signs and blanks between single letters may fall away. Viterbi
decoding finds the likeliest word under a character trigram model, which is counted over all documents.
A logistic model of hashed words and word beginnings, trained with follow-the-regularised-leader on a
bounded sample of labelled rows (``MAX_ROWS``), scores the text with the decoded words added.

Defined results: null and empty texts score as the bias; texts and tokens of any length are read whole;
a document with several labels trains with each, repeated rows each time they occur and label rows that are equal once;
null ids train nothing; without training rows all scores are 0.5; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import expand_text, fold_of, map_text
from .quality import fit, labelled_sample, sigmoid
from .words import ascii_lower, mix, prefix_sums, span_names, spans

BUCKETS = 1 << 17
FAMILIES = 3
SIZE = FAMILIES * BUCKETS + 1
CUTOFF = 0.3
#: Labelled rows that are trained on, about; all in one task.
MAX_ROWS = 20_000
SYMBOLS = 32
#: Characters and the letters that they may stand for (fixed values).
RESEMBLES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "", ".": "", "-": "", "_": "", "'": "", " ": ""}
#: Costs of a substitution, of a letter that falls away from a run, and of a sign that falls away.
SUBSTITUTED, SHORTENED, DROPPED = 1.5, 0.5, 0.5

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % 4
_SYMBOL[48:58] = 31
_LETTER = (_SYMBOL > 0) & (_SYMBOL < 31)
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in RESEMBLES]] = True
_LOOKS = np.zeros(256, bool)
_LOOKS[[ord(c) for c, to in RESEMBLES.items() if to]] = True


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """SYMBOLS^3 counts over the texts of all rows."""

    def make():
        total = np.zeros(SYMBOLS**3, np.int64)

        def fn(raw, offsets, part):
            # two boundaries before each text and one after it
            at = np.repeat(offsets, 3)
            s = np.insert(_SYMBOL[raw], at, 0).astype(np.int64)
            total[:] += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)

        def flush():
            cell = np.flatnonzero(total)
            return [pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(total[cell])], names=["cell", "n"])]

        fn.flush = flush
        return fn

    kinds = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType())])
    found = expand_text(docs.select(F.col(f"`{text}`").alias("text")), "text", [], make, kinds)
    counts = np.zeros(SYMBOLS**3)
    for r in found.groupBy("cell").agg(F.sum("n").alias("n")).collect():  # SYMBOLS^3 rows at most
        counts[r["cell"]] = r["n"]
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


class Decoder:
    """Viterbi decoding of disguised tokens under the trigram model."""

    def __init__(self, counts: np.ndarray):
        self.cost = -np.log((counts + 0.1) / (counts.sum(axis=2, keepdims=True) + 0.1 * SYMBOLS))
        self.known: dict[bytes, bytes] = {}

    def __call__(self, token: bytes) -> bytes:
        if token not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[token] = self.decode(token.lower())
        return self.known[token]

    def arcs(self, token: bytes):
        """Per place: (next place, letters written, cost)."""
        at = 0
        while at < len(token):
            end = at + 1
            while end < len(token) and token[end] == token[at]:
                end += 1
            run, c = end - at, token[at : at + 1]
            if _LETTER[token[at]]:
                out = [(c * run, 0.0)] if run < 3 else []
                out += [(c, SHORTENED)] if run > 1 else []
                out += [(c * 2, SHORTENED)] if run > 2 else []
            else:
                letters = RESEMBLES.get(c.decode("latin-1"), "")
                out = [(x.encode() * min(run, 2), SUBSTITUTED) for x in letters] + ([(x.encode(), SUBSTITUTED + SHORTENED) for x in letters] if run > 1 else [])
                out = out or [(b"", DROPPED * run)]
            yield out
            at = end

    def decode(self, token: bytes) -> bytes:
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for out in self.arcs(token):
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, path) in best.items():
                for written, extra in out:
                    x, y, total = a, b, cost + extra
                    for letter in written:
                        s = int(_SYMBOL[letter])
                        total += self.cost[x, y, s]
                        x, y = y, s
                    if total < new.get((x, y), (np.inf,))[0]:
                        new[x, y] = total, (path, written)
            best = new
        path, written = min(((cost + self.cost[a, b, 0], path) for (a, b), (cost, path) in best.items()), key=lambda x: x[0])[1], []
        while path:
            path, last = path
            written.append(last)
        return b"".join(reversed(written))


def disguised(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Tokens to decode, without signs at their ends, and the text of each."""
    starts, ends, doc = spans(raw, offsets)
    if not len(starts):
        return [], np.zeros(0, int)
    total = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int32)], dtype=np.int32)
    letters, looks = total(_LETTER[raw]), total(_LOOKS[raw])
    thrice = np.zeros(len(raw), bool)
    low = ascii_lower(raw)
    thrice[2:] = (low[2:] == low[1:-1]) & (low[2:] == low[:-2]) & _LETTER[raw[2:]] & (raw[2:] < 128)
    thrices = total(thrice)
    n_letters, n_looks, size = letters[ends] - letters[starts], looks[ends] - looks[starts], ends - starts
    inner = np.zeros(len(raw) + 1, bool)
    inner[1:-1] = _SIGN[raw[1:]] & _LETTER[raw[:-1]]
    split = total(inner[:-1])
    odd = (n_letters >= 2) & ((n_looks > 0) | (thrices[ends] - thrices[np.minimum(starts + 2, ends)] > 0) | (split[ends] - split[starts] >= 3))
    one = (size == 1) & (_LETTER[raw[starts]] | _LOOKS[raw[starts]])
    follows = np.zeros(len(one), bool)
    follows[1:] = one[1:] & one[:-1] & (doc[1:] == doc[:-1])
    first = one & ~follows
    group = np.cumsum(first) - 1
    at, last = np.flatnonzero(first), np.zeros(first.sum(), int)
    np.maximum.at(last, group[one], np.flatnonzero(one))
    long = last - at >= 2
    body = raw.tobytes()
    tokens = [body[a:b].strip(b".,;:!?\"'()-") for a, b in zip(starts[odd], ends[odd], strict=True)]
    tokens += [body[starts[a] : ends[b]] for a, b in zip(at[long], last[long], strict=True)]
    return tokens, np.concatenate([doc[odd], doc[at[long]]])


def word_features(decoder: Decoder):
    """Distinct features of each text: its words and their beginnings of four and five bytes, and of decoded words."""

    def extract(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [_names(raw, offsets, None)]
        tokens, of = disguised(raw, offsets)
        if tokens:
            decoded = [decoder(t) for t in tokens]
            cut = np.concatenate([[0], np.cumsum([len(x) for x in decoded])])
            names, doc = _names(np.frombuffer(b"".join(decoded), np.uint8), cut, of)
            found.append((names, doc))
        names, doc = (np.concatenate(x) for x in zip(*found, strict=True))
        both = np.unique(np.stack([doc.astype(np.int64), names]), axis=1) if len(names) < 1000 else _distinct(doc, names)
        return both[1], both[0]

    return extract


def _distinct(doc: np.ndarray, names: np.ndarray) -> np.ndarray:
    key = np.unique(doc.astype(np.int64) * SIZE + names)
    return np.stack([key // SIZE, key % SIZE])


def _names(raw: np.ndarray, offsets: np.ndarray, of: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    low = ascii_lower(raw)
    inside = (_SYMBOL[raw] > 0) if len(raw) else np.zeros(0, bool)
    starts, ends, doc = spans(low, offsets, inside)
    sums, mask = prefix_sums(low), np.uint64(BUCKETS - 1)
    out = [(mix(span_names(sums, starts, np.minimum(ends, starts + n) if n else ends) + np.uint64(n)) & mask).astype(np.int64) + family * BUCKETS for family, n in enumerate((0, 4, 5))]
    doc = doc if of is None else of[doc]
    return np.concatenate(out), np.concatenate([doc] * FAMILIES)


def train(docs: DataFrame, labels: DataFrame, counts: np.ndarray, label: str, text: str, key: str, folds: int, held_out: int) -> np.ndarray:
    sample = labelled_sample(docs, labels, label, fold_of(key, folds) != held_out, text, key, MAX_ROWS)
    held = docs.sparkSession.sparkContext.broadcast(counts)
    return fit(sample, size=SIZE, gain=None, make=lambda: word_features(Decoder(held.value)), shards=1, epochs=8, alpha=0.5, l1=4.0, l2=0.1)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    counts = trigram_counts(docs, text)
    weights = train(docs, labels, counts, label, text, key, folds, held_out)
    held = docs.sparkSession.sparkContext.broadcast((counts, weights.astype(np.float32)))

    def make():
        extract, w = word_features(Decoder(held.value[0])), held.value[1].astype(float)

        def fn(raw, offsets, part):
            features, of = extract(raw, offsets)
            return {"score": sigmoid(np.bincount(of, w[features], minlength=len(part)) + w[-1])}

        return fn

    out = map_text(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", ["doc_id"], make, [T.StructField("score", T.DoubleType())])
    return out.select("doc_id", (fold_of("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
