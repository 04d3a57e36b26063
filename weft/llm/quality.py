"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader.

Words are runs of letters, digits and non-ASCII bytes, marks are runs of other non-blank bytes. A text's
features are its lower-case words and marks, pairs of neighbours, and n-grams of word shapes (lower case,
capitalised, all capitals, digits, mark), each hashed into ``BUCKETS`` buckets of its own family; a
feature's value is its share of the text's n-grams times ``GAIN``. A score is the logistic function of
the sparse dot product.

Training takes a bounded, documented sample of the labelled rows (``max_rows``), dealt to a fixed number
of shards; each shard runs FTRL-proximal over its rows, and the weights are averaged.

Defined results: null and empty texts have no features and score as the bias; texts of any length count
whole; a document that has several labels trains with each, repeated rows each time they occur and label rows that are
equal once; documents without labels only get scores; null ids train nothing; an empty table or a training set without
rows gives scores of the prior 0.5; other columns are ignored, and ``keep_good`` passes them through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold_of, map_text, slices, text_bytes
from .words import ascii_lower, chain, mix, prefix_sums, span_names, spans

BUCKETS = 1 << 17
FAMILIES = 3
GAIN = 24.0
MAX_ROWS = 20_000
SHARDS = 4
EPOCHS = 4
CUTOFF = 0.3

_SPACES, _WORD, _MARK = 0, 1, 2
_KIND = np.full(256, _MARK, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACES
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = _WORD


def ngrams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all positions of all texts, and the text of each."""
    kind = _KIND[raw]
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = spans(raw, offsets, kind == _WORD)
    m = spans(raw, offsets, kind == _MARK)
    starts, ends = np.concatenate([w[0], m[0]]), np.concatenate([w[1], m[1]])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    doc = np.searchsorted(offsets, starts, "right") - 1
    low = span_names(prefix_sums(ascii_lower(raw)), starts, ends)
    upper = np.concatenate([[0], np.cumsum((raw >= 65) & (raw <= 90))])
    digit = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
    caps, digits, size = upper[ends] - upper[starts], digit[ends] - digit[starts], ends - starts
    shape = np.where(kind[starts] == _MARK, 4, np.where(digits > 0, 3, np.where((caps == size) & (size > 1), 2, (caps > 0).astype(np.int64))))
    shape = shape * 4 + np.minimum(size, 7) // 2
    shape[kind[starts] == _MARK] += 64 * raw[starts[kind[starts] == _MARK]].astype(np.int64)
    mask = np.uint64(BUCKETS - 1)
    out, of = [(low & mask).astype(np.int64)], [doc]
    for family, names, n in ((1, low, 2), (2, mix(shape.astype(np.uint64) + np.uint64(1)), 3)):
        grams = chain(names, n)
        whole = doc[: len(grams)] == doc[n - 1 :] if len(grams) else np.zeros(0, bool)
        out.append((grams[whole] & mask).astype(np.int64) + family * BUCKETS)
        of.append(doc[: len(whole)][whole])
    return np.concatenate(out), np.concatenate(of)


def dots(weights: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The sparse dot product of each text with the weights (the bias is the last weight)."""
    features, of = ngrams(raw, offsets)
    texts = len(offsets) - 1
    sums = np.bincount(of, weights[features], minlength=texts)
    counts = np.maximum(np.bincount(of, minlength=texts), 1)
    return sums / counts * GAIN + weights[-1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss (McMahan et al., 2013)."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = (sigmoid(np.dot(w, x)) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sparse(features: np.ndarray, of: np.ndarray, texts: int, size: int, gain: float | None) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """Distinct features and values of each text, with the bias last. Without a gain, values are None: all are 1."""
    both, count = np.unique(of * size + features, return_counts=True)
    cut = np.searchsorted(both, np.arange(texts + 1) * size)
    out = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        c = count[a:b]
        x = None if gain is None else np.append(c / max(c.sum(), 1) * gain, 1.0).astype(np.float32)
        out.append((np.append(both[a:b] % size, size - 1).astype(np.int32), x))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, text: str, key: str, max_rows: int) -> DataFrame:
    """(text, y) of labelled training rows, about ``max_rows`` of them at most, chosen by a hash of the id."""
    known = labels.filter(F.col(f"`{label}`").isin(0, 1) & F.col(f"`{key}`").isNotNull() & train)
    known = known.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{label}`").cast("double").alias("y")).distinct()
    share = min(1.0, max_rows / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64("__key", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.join(known, "__key").select("text", "y")


def fit(sample: DataFrame, features=ngrams, size: int = FAMILIES * BUCKETS + 1, gain: float | None = GAIN, shards: int = SHARDS, epochs: int = EPOCHS, make=None, **how) -> np.ndarray:
    """Average weights of FTRL over each shard of the sample. Only weights (``size`` numbers a shard) reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extract = features if make is None else make()
        rows, ys = [], []
        for batch in batches:
            for part in slices(batch, 0):
                raw, offsets = text_bytes(part.column(0))
                f, of = extract(raw, offsets)
                rows += sparse(f, of, len(part), size, gain)
                ys += part.column(1).to_pylist()
        if not rows:
            return
        model, order = Ftrl(size, **how), np.random.default_rng(1)
        for _ in range(epochs):
            for i in order.permutation(len(rows)):
                at, x = rows[i]
                model.learn(at, np.ones(len(at)) if x is None else x.astype(float), ys[i])
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)]), pa.array([model.weights().astype(np.float32).tobytes()], pa.binary())], names=["rows", "weights"])

    parts = sample.repartition(shards).mapInArrow(run, "rows long, weights binary").collect()
    if not parts:
        return np.zeros(size)
    total = sum(p["rows"] for p in parts)
    return sum(np.frombuffer(p["weights"], np.float32).astype(float) * (p["rows"] / total) for p in parts)


def scored(docs: DataFrame, weights: np.ndarray, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``score``, the probability that the text is good."""
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def make():
        w = held.value.astype(float)
        return lambda raw, offsets, _: {"score": sigmoid(dots(w, raw, offsets))}

    return map_text(docs, text, keep, make, [T.StructField("score", T.DoubleType())])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", folds: int = 5, held_out: int = 0, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights learned from the labels outside the held-out fold."""
    return fit(labelled_sample(docs, labels, label, fold_of(key, folds) != held_out, text, key, max_rows))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = scored(docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), train(docs, labels, text=text, key=key), ["doc_id"])
    return out.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the classifier doesn't reject, with the columns they came with."""
    names = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    out = scored(docs.withColumnsRenamed(names), train(docs, labels, text=text, key=key), list(names.values()), names[text])
    return out.filter(F.col("score") >= CUTOFF).select(*[F.col(v).alias(c) for c, v in names.items()])
