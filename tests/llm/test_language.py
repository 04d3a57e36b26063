"""Language-model scores against deleted interpolation in plain Python."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import HARD, SCHEMA, rows_of, words

from weft.llm import language


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w] + [None]


def bucket(n):
    return min(n.bit_length(), language.BUCKETS - 1)


def brute(rows):
    """[(n_tokens, n_known, base, score)] of rows (id, text, left out)."""
    role = [0 if zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 else 2 if left else 1 for i, _, left in rows]
    texts = [tokens(t) for _, t, _ in rows]
    pairs = [list(zip([None, *t[:-1]], t, strict=True)) for t in texts]
    one, two = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for r, t, p in zip(role, texts, pairs, strict=True):
        one[r].update(t)
        two[r].update(p)
    words = set(one[1]) | set(one[2])
    v = len(words)

    def estimates(unigrams, bigrams, pair):
        h, w = pair
        return bucket(unigrams[h]), (bigrams[pair] / unigrams[h] if unigrams[h] else 0.0, unigrams[w] / max(sum(unigrams.values()), 1), 1 / (v + 1))

    weights = np.full((language.BUCKETS, 3), 1 / 3)
    events = [(*estimates(one[1], two[1], p), n) for p, n in two[2].items()]
    for _ in range(language.ROUNDS):
        new = np.ones((language.BUCKETS, 3))
        for b, e, n in events:
            share = weights[b] * e
            new[b] += n * share / share.sum()
        new[0, 0] = 0
        new /= new.sum(axis=1, keepdims=True)
        done = np.abs(new - weights).max() < 1e-4
        weights = new
        if done:
            break
    both, pair_counts = one[1] + one[2], two[1] + two[2]
    total, out = sum(both.values()), []
    for t, p in zip(texts, pairs, strict=True):
        score = 0.0
        for x in p:
            b, e = estimates(both, pair_counts, x)
            score += math.log10(float(np.dot(weights[b], e)))
        out.append((len(t), sum(w in words for w in t), sum(math.log10((both[w] + 0.1) / (total + 0.1 * (v + 1))) for w in t), score))
    return out


@pytest.mark.parametrize("limits", [{}, {"word_limit": 25}, {"word_limit": 0}])
def test_scores(spark, limits):
    """Numbered and rare words give the same scores, wherever the bound of the table lies."""
    long = words(2_000 if limits else 300_000, 11, 60)  # above the bytes that numpy looks at together, once
    table = spark.createDataFrame(rows_of([words(60, s, 40 + s) for s in range(60)] + HARD + [long, "only here", None, "Ünïque WORDS words"]), SCHEMA)
    table = table.union(table.limit(3)).union(spark.createDataFrame([(None, "no id", None, None, None, None, None, None, None)], SCHEMA)).repartition(3)
    left = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(3)), F.lit(language.LEFT_OUT)) == 0
    rows = [(r["doc_id"], r["text"], r["left"]) for r in table.select("doc_id", "text", left.alias("left")).collect()]
    want = sorted(((-1 if i is None else i, *x) for (i, _, _), x in zip(rows, brute(rows), strict=True)), key=lambda x: x[:3] + (round(x[3], 5),))
    got = language.score(table, **limits).collect()
    found = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in got), key=lambda x: x[:3] + (round(x[3], 5),))
    assert [x[:3] for x in found] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in found], [x[3] for x in want], rtol=1e-9)
    assert np.allclose([x[4] for x in found], [x[4] for x in want], rtol=1e-6)
    assert {r["train_tokens"] for r in got} == {sum(n for (i, t, _) in rows for n in [len(tokens(t))] if zlib.crc32(str("" if i is None else i).encode()) % 10)}


def test_empty_and_untrained(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert language.score(empty).count() == 0
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = spark.createDataFrame([(held_out, "a b c")], "doc_id long, text string")
    r = language.score(only).first()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) == (True, 4, 0, 0, 0.0, 0.0)


def test_probabilities_sum_to_one():
    weights = np.full((language.BUCKETS, 3), 1 / 3)
    after, both = np.array([5, 3, 2]), np.array([2, 0, 1])  # three words; the context was seen three times
    p = language.mixture(weights, both, np.full(3, 3), after, 10, 3)
    assert np.isclose(p.sum() + (1 / 3) / 4, 1.0)


def test_packing():
    columns = [np.arange(1000, dtype=np.uint64) ** 3, np.arange(1000), np.ones(5)]
    assert all((a == b).all() for a, b in zip(columns, language.unpack(language.pack(columns, language.ASKED_KINDS), language.ASKED_KINDS), strict=True))
