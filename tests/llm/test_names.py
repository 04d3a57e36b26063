"""Words on which every sum of powers agrees: they stay different words."""

import numpy as np
import pytest

from weft.llm import jaccard, language, words


def orders(size):
    """Two words of ``size`` bytes in which a and b change places by the number of ones in each place's number."""
    a, b = "a", "b"
    while len(a) < size:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("size", [1024, 2048])
def test_words_of_one_sum(spark, size):
    a, b = orders(size)
    docs = spark.createDataFrame([(0, a), (1, b), (2, a)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in jaccard.near_duplicates(docs).collect()}
    assert [rows[i]["class_id"] for i in range(3)] == [0, 1, 0]
    docs = spark.createDataFrame([(i, f"{a} {b}") for i in range(40)] + [(99, a)], "doc_id long, text string")
    scored = language.score(docs).collect()
    assert {r["n_known"] for r in scored if r["doc_id"] < 40} == {3}
    import math
    import zlib

    train = [i for i in [*range(40), 99] if zlib.crc32(str(i).encode()) % 10]
    n = sum(2 if i == 99 else 3 for i in train)
    c = len(train)
    want = sum(math.log10((x + 0.1) / (n + 0.1 * 4)) for x in (c, sum(i < 40 for i in train), len(train)))
    assert all(abs(r["base_score"] - want) < 1e-9 for r in scored if r["doc_id"] < 40)


def test_two_sums_of_spans_say_nothing_of_each_other():
    a, b = (x.encode() for x in orders(1024))
    raw = np.frombuffer(b"xy" + a + b"z" + b + a, np.uint8)
    starts = np.array([2, 2 + 1024 + 1, 2 + 2048 + 1])
    plain = words.span_names(words.prefix_sums(raw), starts, starts + 1024)
    mixed = words.span_names(words.mixed_sums(raw), starts, starts + 1024 - words.EIGHT + 1)
    assert len(set(plain.tolist())) == 1
    assert mixed[0] == mixed[2] != mixed[1]
