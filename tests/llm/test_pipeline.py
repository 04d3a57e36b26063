"""The corpus pipeline, stage by stage and as a whole, on the smallest tables."""

import collections
import re

import pytest
from conftest import SMALL, same

import corpus_pipeline
from weft.llm import catalog
from weft.llm.common import durable


@pytest.fixture(scope="module")
def stages(spark):
    """[(name, rows before, rows after)] of each stage on its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        after = durable(stage(spark, docs, SMALL), name)
        out.append((name, docs.toPandas(), after.toPandas()))
        docs = after
    return out


def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    columns = list(stages[0][1].columns)
    for _, _, after in stages[:-1]:
        assert list(after.columns) == columns
    assert list(stages[-1][2].columns) == ["shard", *columns]


def test_near_duplicates_are_gone(stages):
    _, before, after = stages[1]
    sets = [shingles(t) for t in after["text"]]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert len(a & b) * 5 < 4 * len(a | b)
    kept = [shingles(t) for t in after["text"]]
    for t in before["text"]:
        own = shingles(t)
        assert any(len(own & k) * 2 > len(own | k) for k in kept)


def test_benchmark_passages_are_gone(spark, stages):
    _, before, after = stages[2]
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    holds = lambda t: any(x in t for x in items)
    assert not any(holds(t) for t in after["text"])
    gone = set(before["doc_id"]) - set(after["doc_id"])
    assert all(holds(t) for i, t in zip(before["doc_id"], before["text"], strict=True) if i in gone)


def test_mix_repeats_whole_documents(stages):
    _, before, after = stages[3]
    assert set(after["doc_id"]) <= set(before["doc_id"])
    assert max(collections.Counter(after["doc_id"]).values()) <= 3


def test_shards_hold_all(stages):
    _, before, after = stages[4]
    assert collections.Counter(after["doc_id"]) == collections.Counter(before["doc_id"])


def test_run_is_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    same(got, stages[-1][2])


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    a, b = catalog.QUERIES[name](spark, SMALL).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    same(a, b)
