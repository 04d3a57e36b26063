"""Sums that lie midway between two millionths: to the last place, and the same in whatever order rows come."""

import math
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weft.functions.segments import exact_mean, exact_sum
from weft.plans import catalog
from weft.plans.fixtures import SUPPLIERS

CUSTOMERS, SELLERS = 200, 40


def test_exact_sum(spark):
    rng = np.random.default_rng(5)
    groups = {0: rng.standard_normal(999) * 10.0 ** rng.integers(-6, 5, 999), 1: rng.integers(0, 11, 700) / 100 * rng.integers(0, 10**6, 700) / 1e6, 2: np.array([1e6, 0.1, -1e6, -0.0])}
    rows = [(g, float(v)) for g, own in groups.items() for v in own]
    found = []
    for k in (1, 3, 7):
        order = np.random.default_rng(k).permutation(len(rows))
        df = spark.createDataFrame([rows[i] for i in order], "g int, v double").repartition(k)
        found.append({r["g"]: r["s"] for r in df.groupBy("g").agg(exact_sum(F.col("v")).alias("s")).collect()})
    assert found[0] == found[1] == found[2]
    assert found[0] == {g: pytest.approx(math.fsum(own), rel=2e-16, abs=1e-16) for g, own in groups.items()}


def test_exact_sum_of_odd_values(spark):
    rows = [(0, math.nan), (0, 1.0), (1, math.inf), (1, 1.0), (2, None), (3, None), (3, 0.1), (4, 1e300), (4, 1.0), (5, -(2.0**21)), (5, 0.25), (6, 2.0**21 - 0.25), (6, -(2.0**21) + 0.5)]
    out = spark.createDataFrame(rows, "g int, v double").groupBy("g").agg(exact_sum(F.col("v")).alias("s"), exact_mean(F.col("v")).alias("m"), F.sum("v").alias("plain"), F.avg("v").alias("mean"))
    for r in out.collect():
        assert repr(r["s"]) == repr(r["plain"])
        assert repr(r["m"]) == repr(r["mean"])


@pytest.fixture(scope="module")
def midway(tmp_path_factory):
    """(folder, whole amounts and nations): every supplier trades with every customer; the lines of customers 0 and 1 make each sum of discounts times cents end in 50.

    Suppliers' cents times the sum of customers' (of 0 twice, as it is the hub) end in 500,000.
    """
    rng = np.random.default_rng(11)
    cents = rng.integers(-99_999, 10**6, CUSTOMERS)
    cents[:2] = 10, 1
    cents[2:12] = 6 * rng.integers(1, 160_000, 10)  # three lines each
    cents[12] += (100 - cents.sum() - cents[0]) % 200
    own, nations, theirs = 5000 * (2 * rng.integers(50, 100, SELLERS) + 1), rng.integers(0, 25, CUSTOMERS), rng.integers(0, 25, SELLERS)
    lines = pd.DataFrame([(c, s) for s in range(SELLERS) for c in range(CUSTOMERS) for _ in range(3 if 2 <= c < 12 else 1)], columns=["c", "s"])
    lines["d"], lines["t"] = rng.integers(0, 11, len(lines)), rng.integers(0, 9, len(lines))
    total = (lines.d * cents[lines.c] // np.where(lines.c.between(2, 11), 3, 1)).where(lines.c > 1, 0).groupby(lines.s).sum()
    short = (50 - total[lines.s].to_numpy()) % 100
    lines["d"] = np.select([lines.c == 0, lines.c == 1], [short // 10, short % 10], lines.d)
    lines = lines.sample(frac=1, random_state=1).reset_index(drop=True)
    at = tmp_path_factory.mktemp("midway")
    pd.DataFrame({"c_custkey": np.arange(CUSTOMERS), "c_acctbal": cents / 100, "c_nationkey": nations.astype("int32")}).to_parquet(at / "customer.parquet")
    pd.DataFrame({"s_suppkey": np.arange(SELLERS), "s_acctbal": own / 100, "s_nationkey": theirs.astype("int32")}).to_parquet(at / "supplier.parquet")
    pd.DataFrame({"o_orderkey": lines.index, "o_custkey": lines.c}).to_parquet(at / "orders.parquet")
    pd.DataFrame({"l_orderkey": lines.index, "l_suppkey": lines.s, "l_discount": lines.d / 100, "l_tax": lines.t / 100}).to_parquet(at / "lineitem.parquet")
    return str(at), cents, own, nations, theirs, lines


def rows_of(df):
    return {(r["node"], r["dim"]): r["q"] for r in df.collect()}


def test_edge_features_midway(spark, midway):
    at, cents, _, nations, theirs, lines = midway
    want = {(c, d): 10**6 for c in range(CUSTOMERS) for d in (0, 1)}
    pairs = lines.groupby(["s", "c"]).agg(k=("d", "size"), d=("d", "sum"), t=("t", "sum")).reset_index()
    for s, own in pairs.groupby("s"):
        found = sum(Fraction(int(d) * int(cents[c]), 100 * int(k)) for c, k, d in zip(own.c, own.k, own.d, strict=True))
        assert found % 1 == Fraction(1, 2)
        want[SUPPLIERS + s, 0] = 10**6 + math.floor(found + Fraction(1, 2))
        found = sum(Fraction(400 * int(t) * int(nations[c] - theirs[s]), int(k)) for c, k, t in zip(own.c, own.k, own.t, strict=True))
        want[SUPPLIERS + s, 1] = 10**6 + math.floor(found + Fraction(1, 2))
    assert rows_of(catalog.QUERIES["mp_edge_features"](spark, at)) == want


def test_hub_midway(spark, midway):
    """The SQL's products, summed to the last place."""
    at, cents, own, nations, theirs, _ = midway
    x = {i: (cents[i] / 100 / 10000, nations[i] / 25, 1.0, 0.0) for i in range(CUSTOMERS)} | {SUPPLIERS + s: (own[s] / 100 / 10000, theirs[s] / 25, 1.0, 1.0) for s in range(SELLERS)}
    into = {i: [0] for i in x if i} | {SUPPLIERS + s: [0, *range(CUSTOMERS)] for s in range(SELLERS)} | {0: [i for i in x if i]}
    assert set(own * (cents.sum() + cents[0]) % 10**6) == {500_000}
    want = {(i, d): math.floor(math.fsum(x[j][d] * x[i][d] for j in into[i]) * 1e6 + 0.5) for i in x for d in range(4)}
    assert rows_of(catalog.QUERIES["mp_hub"](spark, at)) == want
