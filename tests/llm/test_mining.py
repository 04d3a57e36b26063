"""Importance resampling, embedding near-dedup and collocations on small tables, against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import HARD, SCHEMA, rows_of, words

from weft.llm import collocations, projections, resampling
from weft.llm.common import SLICE_BYTES
from weft.llm.words import hashed

MIXED = ["Änd THE cat, the cat! a1b2 \x7f-x_y é" * 9, "A b C d " * 40, words(30, 3).upper() + ".", "-.,;" * 50, "z" * 300 + " tail"]


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, clashing column names."""
    rows = rows_of([*HARD, *MIXED])
    rows += [(None, words(30, 5), None, None, None, None, None, None, None), (3, "one", "en", "s0", 3, "x", "y", "z", 1), rows[5], rows[7], (5, LONGER, "en", "s1", 1, "x", "y", "z", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


LONGER = words(7000, 98) + " " + "- , " * 300 + words(500, 97)


# Importance resampling


def grams(text, n):
    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


def brute_sample(rows, targets, n, buckets, percent, least, seed=2024):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(map(bucket, grams(x, n)[1]))
    for x in targets:
        t.update(map(bucket, grams(x, n)[1]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out = []
    for i, x in rows:
        w, g = grams(x, n)
        weight = sum(gain(bucket(f)) for f in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    order = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = collections.Counter((*r[:4], k + 1) for k, r in enumerate(order[: len(order) * percent // 100]))
    undrawn = collections.Counter((*r[:4], None) for r in [*order[len(order) * percent // 100 :], *(r for r in out if r[4] < least)])
    return drawn + undrawn


@pytest.mark.parametrize(("n", "size"), [(1, 1 << 16), (1, 50), (3, 64), (2, 1 << 16)])
def test_resampling_against_brute_force(spark, docs, n, size):
    targets = [words(60, 7), "the cat " * 5, None, "", "one two"]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(targets)], "item_id long, text string, score int")
    got = resampling.resample(docs, bench, n=n, size=size, buckets=500, percent=60, least_words=5).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, got)) == brute_sample(rows, targets, n, 500, 60, 5)


def test_resampling_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(docs.limit(0), none).count() == 0
    assert resampling.resample(docs, none).count() == docs.count()


def test_chunks_own_every_word_once():
    raw = np.frombuffer(("  " + words(500, 4) + " -- ünï " + words(100, 5)).encode(), np.uint8)
    w = bytes(raw).decode().replace("--", "").split()
    for n in (1, 4):
        seen = []
        for a, b, owned in resampling.chunks(raw, n, 90):
            part = re.findall(r"[^ -]+", bytes(raw[a:b]).decode())
            assert len(part) <= owned + n - 1
            assert part == w[len(seen) : len(seen) + len(part)]
            seen += part[:owned]
        assert seen == w


def test_crc32():
    raw = np.frombuffer(b"abc" * 100, np.uint8)
    starts, ends = np.array([0, 3, 5, 0, 7]), np.array([300, 3, 9, 64, 72])
    assert resampling.crc32(raw, starts, ends).tolist() == [zlib.crc32(bytes(raw[a:b])) for a, b in zip(starts, ends, strict=True)]


# Collocations


def brute_phrases(rows, support, longest, percent, top):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\n-\r]", text):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    found = {(g, p): a for (g, p), a in f.items() if len(p) > 1 and a >= support}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        if any(g == lang and len(q) > len(p) and inside(p, q) and 100 * b >= percent * a for (g, q), b in found.items()):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), left, right, n[lang]))
    ranked = set()
    for lang, own in out.items():
        for rank, (score, a, p, left, right, total) in enumerate(sorted(own)[:top], 1):
            ranked.add((lang, rank, p.decode(), -a, left, right, total, -score))
    return ranked


PHRASES = [None, "", "a a a a a a a, b a\tb A b!", "new york city. New York, new york city hall", "ünï çödé " * 4] + [words(80, s, 12) for s in range(25)] + [" ".join(words(9, s % 3, 40) for s in range(30))] * 2
LANGS = [None, "en", "en", "de", "und", "en", "x"]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, LANGS[i % len(LANGS)], "s", 1, "x", "y", "z", 1) for i, t in enumerate(PHRASES)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), [(r[2], r[1]) for r in rows]


@pytest.mark.parametrize(("support", "percent", "how"), [(3, 100, {}), (6, 70, {"hot": 5, "cells": 64, "split": 10}), (4, 100, {"hot": 0, "cells": 7, "split": 1}), (2, 100, {"longest": 3, "top": 7})])
def test_collocations_against_brute_force(texts, support, percent, how):
    table, rows = texts
    got = {tuple(r) for r in collocations.mine(table, support=support, percent=percent, **how).collect()}
    assert got == brute_phrases(rows, support, how.get("longest", 5), percent, how.get("top", 2000))


def test_collocations_of_hard_rows(docs):
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    got = {tuple(r) for r in collocations.mine(docs, support=5).collect()}
    assert got == brute_phrases(rows, 5, 5, 100, 2000)
    assert collocations.mine(docs.limit(0)).count() == 0


def test_collocations_in_a_long_text(spark):
    text = words(400_000, 31, 60_000) + " " + "deep learning " * 120 + "x" * (SLICE_BYTES + 5)
    assert len(text) > 2 * SLICE_BYTES
    table = spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string")
    got = {(r["phrase"], r["a"]) for r in collocations.mine(table).collect()}
    assert ("deep learning deep learning deep", 118) in got
    assert ("deep learning", 120) in got


def test_names_of_words():
    raw = np.frombuffer(b"abcdefghij" * 40, np.uint8)
    starts, ends = np.array([0, 10, 1, 0, 0, 3, 5]), np.array([8, 18, 9, 9, 400, 3, 70])
    names = hashed(raw, starts, ends)
    assert names[0] == names[1]
    assert len(set(names.tolist())) == 6
    a, b = b"a", b"b"
    for _ in range(11):
        a, b = a + b, b + a
    for seed in (0, 7):  # words on which every sum of powers agrees
        raw = np.frombuffer(a + b, np.uint8)
        first, second = hashed(raw, np.array([0, len(a)]), np.array([len(a), 2 * len(a)]), seed)
        assert first != second


# Embedding near-dedup


def brute_links(rows, cosine=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.array([rows[i][1] for i in ok], float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= cosine
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for p, q in np.argwhere(near).tolist():
        if p != q:
            links[ok[p]] += 1
            root[find(ok[p])] = find(ok[q])
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return [(rows[i][0], links[i], least.get(find(i)), rows[i][0] is not None and rows[i][0] == least[find(i)]) for i in range(len(rows))]


def around(base, angle, n, rng):
    noise = rng.standard_normal((n, len(base)))
    noise -= (noise @ base)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return np.cos(angle) * base + np.sin(angle) * noise


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((700, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    big = around(x[0], math.acos(0.985), 500, rng)  # all linked with each other
    wide = around(x[1], math.acos(0.955), 120, rng)  # linked in part
    pairs = np.concatenate([around(v, math.acos(c), 1, rng) for v, c in zip(x[2:120], np.linspace(0.88, 0.99, 118), strict=True)])
    body = np.concatenate([x, big, wide, pairs, x[:40], 3 * x[40:60]])
    order = rng.permutation(len(body))
    rows = [(int(i), body[k].tolist()) for i, k in enumerate(order)]
    same = x[300].tolist()
    rows += [(5000 + i, same) for i in range(60)] + [(None, same), (None, x[301].tolist()), (7, x[302].tolist()), (7, same)]
    rows += [(9000, None), (9001, [0.0] * 16), (9002, [1.0] * 15), (9003, [math.nan] + [1.0] * 15), (9004, [None] + [1.0] * 15), (9005, [math.inf] + [1.0] * 15), (None, None)]
    rows += [(9006, (1e200 * x[303]).tolist()), (9007, (1e-200 * x[303]).tolist())]
    return rows


@pytest.mark.parametrize("tile", [1024, 100])
def test_near_embeddings_against_brute_force(spark, vectors, monkeypatch, tile):
    monkeypatch.setattr(projections, "TILE", tile)
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in vectors], "vec_id long, embedding array<double>, cls int, tab string").repartition(3)
    got = projections.near_duplicates(df).collect()
    true = brute_links(vectors)
    assert len(got) == len(true)
    if collections.Counter(map(tuple, got)) != collections.Counter(true):  # links that no table and no count has found
        want, have = sum(r[1] for r in true), sum(r["n_links"] for r in got)
        assert 0.95 * want <= have < want
        most = {r[0]: r[1] for r in true}
        assert all(r["n_links"] <= most[r["vec_id"]] for r in got if r["vec_id"] not in (None, 7))


def test_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((20_000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cuts = projections.Cuts(x[:4000], 1_000_000, 0.9)
    y = np.concatenate([around(v, math.acos(0.9), 1, rng) for v in x[4000:8000]])
    together = (cuts.blocks(x[4000:8000]) == cuts.blocks(y)).any(axis=1).mean()
    assert together > 0.95
    lines = rng.standard_normal((32, projections.LINES))
    half = projections.WIDTH * math.sqrt(0.2)
    count = (np.abs((x[4000:8000] - y) @ lines) <= half).sum(axis=1)
    assert (count >= projections.least_count()).mean() > 0.985


def test_near_embeddings_of_empty_tables(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert projections.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None), (None, [])], "vec_id long, embedding array<float>")
    assert sorted(map(str, projections.near_duplicates(df).collect())) == sorted(["Row(vec_id=1, n_links=0, component_id=1, kept=True)", "Row(vec_id=None, n_links=0, component_id=None, kept=False)"])
    assert projections.near_duplicates(df).agg(F.count("*")).first()[0] == 2
