"""User aggregates, index checks, products of tables, and layers with a state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import mergeable
from weft.functions.mergeable import LogSumExp, SegmentAggregate, Variance, aggregate
from weft.functions.segments import FILLS, REDUCERS, reducer_name, register_reducer
from weft.operators import blocks
from weft.operators import convolutions as C
from weft.operators.aggregators import MaxAggregation, SumAggregation, UserAggregation, assert_sorted_index, index_of_ptr
from weft.operators.message_passing import MessagePassing
from weft.operators.params import from_config
from weft.operators.stateful import BatchNormalization, Dropout
from weft.sources.graph import Graph


@pytest.fixture(scope="module")
def rows(spark):
    """Half of all rows in segment 3, spread over all partitions; a null segment and null vectors."""
    rng = np.random.default_rng(0)
    index = np.where(np.arange(3000) % 2, 3, rng.integers(0, 40, 3000))
    x = rng.standard_normal((3000, 2)) * 10
    data = [(int(i), "b" if k % 3 else None, v) for k, (i, v) in enumerate(zip(index, x.tolist(), strict=True))]
    data += [(None, "a", [1.0, 2.0]), (None, "a", [3.0, 2.0]), (7, "a", None)]
    return spark.createDataFrame(data, "index long, other string, x array<double>").repartition(6), index, x


@pytest.mark.parametrize("held", [1 << 16, 3])
def test_user_aggregates(spark, rows, monkeypatch, held):
    monkeypatch.setattr(mergeable, "HELD", held)
    df, index, x = rows
    for how, brute in ((Variance(), lambda v: v.var(axis=0)), (LogSumExp(), lambda v: np.log(np.exp(v).sum(axis=0)))):
        got = {r["index"]: r["h"] for r in aggregate(df, ["index"], "x", how).collect()}
        assert set(got) == {*index.tolist(), None}
        for i in np.unique(index):
            np.testing.assert_allclose(got[i], brute(x[index == i]), atol=1e-9)
        np.testing.assert_allclose(got[None], brute(np.array([[1.0, 2.0], [3.0, 2.0]])), atol=1e-12)


def test_a_hub_segment_is_reduced_in_several_tasks(spark, rows):
    """What is merged of a segment is a state for each task, not its rows."""

    class States(SegmentAggregate):
        def start(self, data, index, count):
            return np.ones((count, 1))

        def width(self, dim):
            return 1

    df, *_ = rows
    got = {r["index"]: r["h"][0] for r in aggregate(df, ["index"], "x", States()).collect()}
    assert 1 < got[3] <= 6


def test_several_keys(rows):
    df, *_ = rows
    got = {(r["other"], r["index"]): r["h"][0] for r in aggregate(df, ["other", "index"], "x", Variance()).collect()}
    want = {(r["other"], r["index"]): r["v"] for r in df.filter("x is not null").groupBy("other", "index").agg(F.var_pop(F.col("x")[0]).alias("v")).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_layers_take_user_aggregates(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((20, 3))
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 20, (60, 2))})
    g = Graph(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, x array<double>"), spark.createDataFrame(pairs, "src long, dst long"), 3)
    got = {r["node"]: r["h"] for r in MessagePassing(Variance())(g).collect()}
    for i in range(20):
        own = [a for a, b in pairs if b == i]
        np.testing.assert_allclose(got[i], x[own].var(axis=0) if own else [0, 0, 0], atol=1e-12)
    register_reducer("variance", Variance(), fill=-1.0)
    layer = MessagePassing("variance")
    again = from_config(layer.config())
    got = {r["node"]: r["h"] for r in again(g).collect()}
    assert [got[i] for i in range(20) if i not in {b for _, b in pairs}] == [[-1.0] * 3 for i in range(20) if i not in {b for _, b in pairs}]
    assert reducer_name(REDUCERS["variance"]) == "variance"
    del REDUCERS["variance"], FILLS["variance"]


def test_aggregates_of_nothing(spark):
    df = spark.createDataFrame([], "index long, x array<double>")
    assert aggregate(df, ["index"], "x", Variance()).count() == 0
    with pytest.raises(ValueError, match="unknown"):
        UserAggregation("median")


# Index


def test_sorted_index(spark):
    in_order = spark.range(0, 1000, 1, 7).select((F.col("id") / 3).cast("long").alias("index"), F.array(F.lit(1.0)).alias("x"))
    assert_sorted_index(in_order)
    assert_sorted_index(in_order.limit(0))
    assert SumAggregation()(in_order, 1, check_sorted=True).count() == 334
    for odd in (500, 143, 999):  # in the middle of a partition, at its start, at the end
        wrong = spark.range(0, 1000, 1, 7).select(F.when(F.col("id") == odd, -5).otherwise((F.col("id") / 3).cast("long")).alias("index"), F.array(F.lit(1.0)).alias("x"))
        with pytest.raises(ValueError, match="not sorted"):
            assert_sorted_index(wrong)
    nulls = spark.range(0, 50, 1, 4).select(F.when(F.col("id") % 5 > 0, F.col("id")).alias("index"))
    assert_sorted_index(nulls)
    with pytest.raises(ValueError, match="not sorted"):
        SumAggregation()(in_order.orderBy(F.desc("index")), 1, check_sorted=True)


def test_dim_size(spark):
    df = spark.createDataFrame([(0, [1.0]), (2, [2.0]), (2, [3.0])], "index long, x array<double>")
    got = sorted((r["index"], r["h"]) for r in SumAggregation()(df, 1, dim_size=5).collect())
    assert got == [(0, [1.0]), (1, [0.0]), (2, [5.0]), (3, [0.0]), (4, [0.0])]
    assert MaxAggregation(fill=-1.0)(df, 1, dim_size=4).count() == 4
    with pytest.raises(Exception, match="dim_size is 2"):
        SumAggregation()(df, 1, dim_size=2).collect()


def test_ptr(spark):
    df = spark.range(6).select(F.col("id").alias("row"), F.array(F.col("id").cast("double")).alias("x"))
    got = {r["index"]: r["h"] for r in SumAggregation()(index_of_ptr(df, [0, 2, 2, 5]), 1, dim_size=3).collect()}
    assert got == {0: [1.0], 1: [0.0], 2: [9.0]}
    with pytest.raises(ValueError, match="ptr"):
        index_of_ptr(df, [0, 3, 2])


# Products of tables


@pytest.mark.parametrize(("size", "columns"), [(4096, 1024), (7, 4), (50, 9)])
def test_products_of_tables(spark, size, columns):
    rng = np.random.default_rng(4)
    a, b, c = rng.standard_normal((60, 10)), rng.standard_normal((10, 13)), rng.standard_normal((60, 13))
    frame = lambda m: spark.createDataFrame([(i, v) for i, v in enumerate(m.tolist())], "row long, x array<double>").repartition(3)
    back = lambda df, n, w: np.array([r["h"] for r in sorted(df.collect())]).reshape(n, w)
    np.testing.assert_allclose(back(blocks.product(frame(a), frame(b), 10, 13, rows=size, columns=columns), 60, 13), a @ b, atol=1e-9)
    np.testing.assert_allclose(back(blocks.cross_product(frame(a), frame(c), 10, 13, rows=size, columns=columns), 10, 13), a.T @ c, atol=1e-9)
    # rows that are missing count as zeros
    some = frame(b).filter("row not in (3, 9)")
    b[[3, 9]] = 0
    np.testing.assert_allclose(back(blocks.product(frame(a), some, 10, 13, rows=size, columns=columns), 60, 13), a @ b, atol=1e-9)
    a[:20] = 0
    np.testing.assert_allclose(back(blocks.cross_product(frame(a).filter("row >= 20"), frame(c).filter("row < 59"), 10, 13, rows=size, columns=columns), 10, 13), a[:59].T @ c[:59], atol=1e-9)
    assert blocks.product(frame(a).limit(0), frame(b), 10, 13).count() == 0


# Layers with a state


@pytest.fixture(scope="module")
def graph(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((50, 4)) * 3 + 1
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 50, (200, 2))})
    return Graph(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, x array<double>"), spark.createDataFrame([(a, b, 0.25) for a, b in edges], "src long, dst long, w double"), 4), x


def features(df):
    return np.array([r["x" if "x" in df.columns else "h"] for r in sorted(df.collect())])


def test_moving_statistics(spark, graph):
    g, x = graph
    layer = BatchNormalization(4, momentum=0.9)
    mean, variance = np.zeros(4), np.ones(4)
    for k in range(3):
        own = Graph(g.nodes.withColumn("x", F.transform("x", lambda v: v * (k + 1))), g.edges, 4)  # noqa: B023
        got = features(layer(own, draw=k))
        y = x * (k + 1)
        np.testing.assert_allclose(got, (y - y.mean(axis=0)) / np.sqrt(y.var(axis=0) + 1e-3), atol=1e-9)
        mean, variance = 0.9 * mean + 0.1 * y.mean(axis=0), 0.9 * variance + 0.1 * y.var(axis=0)
    np.testing.assert_allclose(layer.weights["mean"], mean, atol=1e-9)
    np.testing.assert_allclose(layer.weights["variance"], variance, atol=1e-9)
    np.testing.assert_allclose(features(layer(g)), (x - mean) / np.sqrt(variance + 1e-3), atol=1e-9)
    other = BatchNormalization(4).restore(layer.state(spark))
    np.testing.assert_allclose(features(other(g)), features(layer(g)), atol=1e-12)
    with pytest.raises(ValueError, match="0 values"):
        other.restore(layer.state(spark), "another")


def test_a_drawn_stack(graph):
    """The example's stack: ARMA, batch normalisation and dropout, twice, and an ARMA with a softmax."""
    g, _ = graph

    def run(draw):
        norms = [BatchNormalization(3), BatchNormalization(3)]
        layers = [(C.ARMAConv(3, activation="relu", seed=1), 3), (norms[0], 3), (Dropout(0.5), 3), (C.ARMAConv(3, activation="relu", seed=2), 3), (norms[1], 3), (Dropout(0.5), 3), (C.ARMAConv(2, activation="softmax", seed=3), 2)]
        return features(g.stack(layers, draw).nodes), norms

    plain, still = run(None)
    one, moved = run(1)
    again, _ = run(1)
    other, _ = run(2)
    np.testing.assert_array_equal(one, again)
    assert not np.allclose(one, other)
    assert not np.allclose(one, plain)
    np.testing.assert_allclose(one.sum(axis=1), 1, atol=1e-9)
    assert (still[0].weights["mean"] == 0).all()
    assert (moved[0].weights["variance"] != 1).any()
    first = g.through(C.ARMAConv(3, activation="relu", seed=1), 3, 1000)
    y = features(first.nodes)
    np.testing.assert_allclose(moved[0].weights["mean"], 0.01 * y.mean(axis=0), atol=1e-12)
    normal = features(first.through(BatchNormalization(3), 3, 1001).nodes)
    fallen = features(first.through(BatchNormalization(3), 3, 1001).through(Dropout(0.5), 3, 1002).nodes)
    stays = fallen != 0
    np.testing.assert_allclose(fallen[stays], 2 * normal[stays], atol=1e-12)
    assert 0.3 < stays.mean() < 0.7
