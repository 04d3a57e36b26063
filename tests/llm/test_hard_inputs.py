"""Texts above the bytes that numpy looks at together, in every operator on texts; and the whole pipeline on hard tables."""

import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import HARD, SCHEMA, rows_of, words

import corpus_pipeline
from weft.llm import decontaminate, jaccard, mixing, quality, sharding, suffixes, toxicity
from weft.llm.common import SLICE_BYTES

ITEM = words(40, 700)
BASE = words(260_000, 701, 60_000)
NEAR = BASE.replace(" ", "  ", 5).rsplit(" ", 3)[0]
TEXTS = [BASE, NEAR, BASE + " " + ITEM, ITEM + " " + words(30, 702), words(50, 703), "x" * (SLICE_BYTES + 1), None, ""]


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame(rows_of(TEXTS), SCHEMA).repartition(2)


def test_texts_are_long():
    assert len(BASE) > SLICE_BYTES


def test_sizes(long):
    size = {r["doc_id"]: r["size"] for r in mixing.mix_plan(long).collect()}
    assert [size[i] for i in range(len(TEXTS))] == [len((t or "").split()) for t in TEXTS]
    size = {r["doc_id"]: r["size"] for r in sharding.shard_documents(long, shards=3).collect()}
    assert [size[i] for i in range(len(TEXTS))] == [len(t or "") + 8 for t in TEXTS]


def test_metadata_that_is_not_finite(spark):
    rows = [(i, words(5, i), float(v)) for i, v in enumerate(["nan", "inf", "-inf", "1", "2", "3"] * 5)] + [(None, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, m double")
    out = sharding.shard_documents(docs, shards=4, dims=("m",)).collect()
    assert len(out) == 31
    assert {r["shard"] for r in out} <= set(range(4))


def test_leaks(spark, long):
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    found = {r["doc_id"]: r["first_word"] for r in decontaminate.leaks(long, bench).collect()}
    assert found == {2: 260_000, 3: 0}
    assert {r["doc_id"] for r in decontaminate.clean(long, bench).collect()} == set(range(len(TEXTS))) - {2, 3}


def test_near_copies(long):
    rows = {r["doc_id"]: r for r in jaccard.near_duplicates(long).collect()}
    assert [rows[i]["class_id"] for i in range(len(TEXTS))] == [0, 0, 0, 3, 4, 5, 6, 6]
    assert [rows[i]["links"] for i in range(3)] == [2, 2, 2]


def test_scores(spark, long):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    for f in (quality.classify, toxicity.classify):
        rows = f(long, labels).collect()
        assert len(rows) == len(TEXTS)
        assert all(0 <= r["score"] <= 1 for r in rows)


def test_repeats(long):
    length, where = suffixes.LENGTH, collections.Counter()
    raw = [(t or "").encode() for t in TEXTS]
    names = [[hash(x[p : p + length]) for p in range(len(x) - length + 1)] for x in raw]
    for own in names:
        where.update(own)
    got = {r["doc_id"]: r for r in suffixes.remove_repeats(long).collect()}
    for i, (x, own) in enumerate(zip(raw, names, strict=True)):
        step = np.zeros(len(x) + 1, int)
        for p, n in enumerate(own):
            if where[n] > 1:
                step[p] += 1
                step[p + length] -= 1
        gone = np.cumsum(step[:-1]) > 0
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (int(gone.sum()), hashlib.sha256(kept).hexdigest())


# The pipeline

GOOD = [words(80, 800 + k) for k in range(30)]


def tables(spark, path, docs, labels, bench):
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, shard string, score string, size string, root string"


def test_pipeline_on_hard_rows(spark, tmp_path):
    bad = ["%%% ### @@@ " * 20 + str(k) for k in range(40)]
    texts = HARD + GOOD + GOOD[:5] + [t.rsplit(" ", 1)[0] for t in GOOD[5:10]] + [g + " " + ITEM for g in GOOD[:2]] + bad
    rows = [(i, t, "en", f"s{i % 2}" if i % 7 else None, len(t or ""), "a", "b", "c", "d") for i, t in enumerate(texts)]
    rows += [(None, words(60, 900 + k), None, None, None, None, None, None, None) for k in range(3)]  # different texts without an id
    rows += [(5000, words(60, 910 + k), "en", "s0", 1, "a", "b", "c", "d") for k in range(3)]  # and under one
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3)
    known = [(i, int(t not in bad), 0) for i, t in enumerate(texts) if t] + [(None, 1, 0), (3, None, None)]
    at = tables(spark, tmp_path, docs, spark.createDataFrame(known, "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, ITEM), (None, None), (2, "")], "item_id long, text string"))
    before, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = spark.createDataFrame(stage(spark, before, at).collect(), ("shard int, " + DOCUMENTS.replace("shard string, ", "")) if name == "shard" else DOCUMENTS)
        kept[name] = [(r["doc_id"], r["text"]) for r in after.collect()]
        if name != "shard":
            assert after.columns == docs.columns
        before = after
    assert not {t for _, t in kept["quality"]} & set(bad)
    assert set(GOOD) <= {t for _, t in kept["quality"]}
    assert len([1 for i, _ in kept["near_duplicates"] if i is None]) == 3
    assert len([1 for i, _ in kept["near_duplicates"] if i == 5000]) == 3
    near = collections.Counter(t for _, t in kept["near_duplicates"])
    assert all(near[g] == 1 for g in GOOD[10:])
    assert max(near.values()) == 1
    assert not [t for _, t in kept["decontaminate"] if t and ITEM in t]
    assert collections.Counter(kept["shard"]) == collections.Counter(kept["mix"])
    whole = corpus_pipeline.run(spark, at)
    assert whole.columns == ["shard", *[c for c in docs.columns if c != "shard"]]
    assert collections.Counter((r["doc_id"], r["text"]) for r in whole.collect()) == collections.Counter(kept["shard"])


def test_pipeline_on_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], DOCUMENTS)
    at = tables(spark, tmp_path, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string"))
    out = corpus_pipeline.run(spark, at)
    assert out.count() == 0
    assert out.columns == ["shard", *[c for c in docs.columns if c != "shard"]]
