"""Large groups of near copies: exact links, and rows that grow with the group."""

import collections

import numpy as np
from test_operators import shingles, words

from weft.llm import jaccard


def variants(base, count, edits, seed):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(count):
        w = base.split()
        for at in rng.integers(0, len(w), edits(rng)):
            w[at] = f"e{seed}x{k}x{at}" if rng.random() < 0.7 else f"e{rng.integers(0, 5)}"
        out.append(" ".join(w))
    return out


def brute(texts):
    """(links, class_links, label) of each text."""
    sets = [frozenset(shingles(t)[0]) for t in texts]
    number = {s: i for i, s in enumerate(dict.fromkeys(sets))}
    of = [number[s] for s in sets]
    column = {}
    for s in number:
        for g in s:
            column.setdefault(g, len(column))
    m = np.zeros((len(number), len(column)), np.float32)
    for s, i in number.items():
        m[i, [column[g] for g in s]] = 1
    common = np.rint(m @ m.T).astype(int)
    size = m.sum(axis=1).astype(int)
    linked = common * 5 >= 4 * (size[:, None] + size[None] - common)
    np.fill_diagonal(linked, False)
    copies = np.bincount(of)
    label = np.arange(len(copies))
    while True:
        new = np.minimum(label, np.where(linked, label[None], len(label)).min(axis=1))
        if (new == label).all():
            break
        label = new
    return [(int(linked[i] @ copies + copies[i] - 1), int(linked[i].sum()), int(label[i])) for i in of]


def test_links_in_large_groups(spark):
    base = [words(70, 900 + k) for k in range(3)]
    texts = variants(base[0], 420, lambda r: r.integers(0, 3), 1)  # around a text that is there
    texts += variants(base[0], 60, lambda r: r.integers(3, 6), 2)  # and far from it
    texts += variants(base[1], 400, lambda r: 2, 3)  # around a text that isn't
    chain = [words(70, 1000)]
    for k in range(300):  # each is like the one before
        chain.append(" ".join([*chain[-1].split()[2:], f"c{k}", f"d{k}"]))
    texts += chain + texts[:40] + texts[480:500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = {r["doc_id"]: r for r in jaccard.near_duplicates(docs).collect()}
    want = brute(texts)
    assert [(rows[i]["links"], rows[i]["class_links"]) for i in range(len(texts))] == [x[:2] for x in want]
    classes = collections.defaultdict(set)
    for i, x in enumerate(want):
        classes[x[2]].add(i)
    first = {i: min(own) for own in classes.values() for i in own}
    assert [rows[i]["class_id"] for i in range(len(texts))] == [first[i] for i in range(len(texts))]
    assert jaccard.one_of_each(docs).count() == len(classes)


def test_rows_grow_with_a_group(spark, monkeypatch):
    made, in_cells = [], jaccard.in_cells
    monkeypatch.setattr(jaccard, "in_cells", lambda members, group: (made.append(in_cells(members, group)), made[-1])[1])
    rows = {}
    for n in (1000, 5000):
        made.clear()
        texts = variants(words(150, 77), n, lambda r: 1, 5)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
        out = jaccard.near_duplicates(docs).collect()
        assert {r["class_id"] for r in out} == {0}
        rows[n] = sum(x.count() for x in made)
    assert rows[5000] <= 5 * max(rows[1000], 1000)
