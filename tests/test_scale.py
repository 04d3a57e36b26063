"""Hubs, rounds that move states only, and large batches: same results, even tasks, plans without needless exchanges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions.segments import segment_softmax
from weft.operators import convolutions as C
from weft.operators.adjacency import adj_matmul
from weft.operators.attention import linear_attention
from weft.operators.message_passing import MessagePassing
from weft.sources import balance, layout
from weft.sources.balance import Heavy
from weft.sources.graph import Graph
from weft.sources.layout import Layout, states

N, DIM = 600, 3


@pytest.fixture(scope="module")
def hub(spark):
    """Half of all 40,000 edges come from node 7 and half go to it; the others are even."""
    rng = np.random.default_rng(2)
    src, dst = rng.integers(0, N, 40_000), rng.integers(0, N, 40_000)
    dst[:20_000] = 7
    src[10_000:30_000] = 7
    w = np.round(rng.random(40_000), 3)
    x = rng.standard_normal((N, DIM)).round(3)
    edges = spark.createDataFrame(list(zip(src.tolist(), dst.tolist(), w.tolist(), strict=True)), "src long, dst long, w double")
    nodes = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, x array<double>")
    a = np.zeros((N, N))
    np.add.at(a, (src, dst), w)
    count = np.zeros((N, N))
    np.add.at(count, (src, dst), w != 0)
    return Graph(nodes, edges, DIM), a, count, x


def matrix(df, h="h", dim=DIM):
    out = np.full((N, dim), np.nan)
    for r in df.collect():
        out[r["node"]] = r[h]
    return out


def joined(spark):
    """Sort-merge joins, as between large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")


@pytest.fixture
def large(spark):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    joined(spark)
    yield lambda n: spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_heavy_places(spark, hub):
    g, *_ = hub
    many = Heavy(g.edges, ["dst"])
    limit = 40_000 // (4 * balance.SHARE)
    assert list(many.salts.values()) == [-(-20_000 // limit)] or sum(many.salts.values()) * limit >= 20_000
    assert len(many.salts) == 1
    assert not Heavy(g.nodes, ["node"])
    assert not Heavy(g.edges.limit(0), ["dst"])


def test_rows_a_task(spark, hub, large):
    """No task reads above three times the median."""
    g, *_ = hub
    large(8)
    side = g.nodes.select(F.col("node").alias("dst"), "x")
    many = Heavy(g.edges, ["dst"])
    for dealt, even in ((many.join(g.edges, side), True), (g.edges.join(side, "dst"), False)):
        sizes = np.array([r["count"] for r in dealt.groupBy(F.spark_partition_id().alias("p")).count().collect()])
        assert sizes.sum() == 40_000
        assert (sizes.max() <= 3 * np.median(sizes)) == even


def test_products_with_a_hub(hub):
    g, a, count, x = hub
    np.testing.assert_allclose(matrix(adj_matmul(g.edges, g.nodes, "x", DIM)), a @ x, atol=1e-8)
    np.testing.assert_allclose(matrix(adj_matmul(g.edges, g.nodes, "x", DIM, transpose=True)), a.T @ x, atol=1e-8)
    np.testing.assert_allclose(matrix(MessagePassing()(g)), count.T @ x, atol=1e-8)

    class Both(MessagePassing):
        def message(self, c):
            return F.zip_with(c.source("x"), c.target("x"), lambda s, t: s * t)

    np.testing.assert_allclose(matrix(Both()(g)), (count.T @ x) * x, atol=1e-8)
    h = C.SAGEConv(2, weights={"rel": np.eye(DIM)[:, :2], "root": np.zeros((DIM, 2))})(g)
    np.testing.assert_allclose(matrix(h, dim=2), (a @ x / np.maximum(a.sum(axis=1), 1)[:, None])[:, :2], atol=1e-8)


def test_batched_product_with_a_hub(spark, hub):
    g, a, _, x = hub
    edges = g.edges.withColumn("batch", F.lit(1).cast("long")).union(g.edges.withColumn("batch", F.lit(2).cast("long")))
    nodes = g.nodes.withColumn("batch", F.lit(1).cast("long")).union(g.nodes.select("node", F.transform("x", lambda v: -v), F.lit(2).cast("long")))
    out = adj_matmul(edges, nodes, "x", DIM)
    np.testing.assert_allclose(matrix(out.filter("batch = 2")), -(a @ x), atol=1e-8)


def test_softmax_of_a_large_segment(spark, monkeypatch):
    monkeypatch.setattr(balance, "LEAST", 10)
    monkeypatch.setattr(balance, "SHARE", 1000)
    rng = np.random.default_rng(3)
    seg, v = np.where(np.arange(500) < 400, 1, rng.integers(0, 9, 500)), rng.standard_normal(500) * 20
    df = spark.createDataFrame([(i, int(s), float(x)) for i, (s, x) in enumerate(zip(seg, v, strict=True))], "at long, seg long, v double")
    got = {r["at"]: r["alpha"] for r in segment_softmax(df, ["seg"], "v").collect()}
    for s in np.unique(seg):
        own = np.flatnonzero(seg == s)
        e = np.exp(v[own] - v[own].max())
        np.testing.assert_allclose([got[i] for i in own.tolist()], e / (e.sum() + 1e-9), atol=1e-12)


# Rounds


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "Reused" not in line]


def test_a_round_moves_states_once(spark, hub, large):
    g, a, _, x = hub
    laid = Layout(g.edges)
    assert laid.hubs == [7]
    at = states(g.nodes)
    plan = exchanges(laid.product(at, "x", DIM, keep=("x",)))
    moves = [p for p in plan if "BroadcastExchange" not in p]
    assert len(moves) == 1, plan
    assert len(plan) <= 2  # the states of hubs
    assert "hashpartitioning(node" in moves[0]
    for _ in range(3):
        x = a @ x / 100
        at = states(laid.product(at, "x", DIM).select("node", F.transform("h", lambda v: v / 100).alias("x")), aligned=True)
    np.testing.assert_allclose(matrix(at, "x"), x, atol=1e-8)


def test_layout_without_hubs_and_other_reductions(hub):
    g, _, count, x = hub
    few = Layout(g.edges.filter("w <> 0"), "src", "dst", least=10**9)
    assert few.hubs == []
    assert few.dealt is None
    np.testing.assert_allclose(matrix(few.product(states(g.nodes), "x", DIM, weigh=False)), count.T @ x, atol=1e-8)
    top = Layout(g.edges.filter("w <> 0"), "src", "dst").product(states(g.nodes), "x", DIM, how="max", weigh=False, fill=-9.0)
    want = np.where(count.T[:, :, None] > 0, x[None], -9.0).max(axis=1)
    np.testing.assert_allclose(matrix(top), want, atol=1e-12)


def test_ten_rounds(hub):
    g, a, _, x = hub
    scaled = Graph(g.nodes, g.edges.withColumn("w", F.col("w") / 12_000), DIM)
    h = C.APPNPConv(DIM, alpha=0.3, propagations=10, weights={"mlp0": np.eye(DIM)})(scaled)
    z = x
    for _ in range(10):
        z = 0.7 * (a / 12_000) @ z + 0.3 * x
    np.testing.assert_allclose(matrix(h), z, atol=1e-8)


def test_empty_layout(spark):
    g = Graph(spark.createDataFrame([(1, [1.0])], "node long, x array<double>"), spark.createDataFrame([], "src long, dst long, w double"), 1)
    assert [tuple(r) for r in Layout(g.edges).product(states(g.nodes), "x", 1).collect()] == [(1, [0.0])]


# Linear attention


@pytest.mark.parametrize("share", [1, 10**6])
def test_large_batches(spark, monkeypatch, share):
    """One batch with nearly all rows, dealt in salts or not; rows keep their other columns."""
    monkeypatch.setattr(balance, "LEAST", 50)
    monkeypatch.setattr(balance, "SHARE", share)
    rng = np.random.default_rng(1)
    n, m, d, heads = 900, 4, 3, 2
    q, k, v = rng.random((n, heads * m)), rng.random((n, heads * m)), rng.standard_normal((n, heads * d))
    batch = np.where(np.arange(n) < 850, 5, np.arange(n) % 7)
    mask = np.arange(n) % 3 != 0
    rows = spark.createDataFrame([(int(b), i, *(y.tolist() for y in (q[i], k[i], v[i])), bool(mask[i]), "s", None) for i, b in enumerate(batch)], "batch int, node long, q array<double>, k array<double>, v array<double>, mask boolean, kind string, h array<double>")
    out = linear_attention(rows.repartition(5), m, d, heads=heads)
    assert set(out.columns) == set(rows.columns)
    got = {r["node"]: r["h"] for r in out.collect()}
    assert len(got) == n
    for b in np.unique(batch):
        own = np.flatnonzero(batch == b)
        for h in range(heads):
            a, c, e = q[own, h * m : (h + 1) * m], k[own, h * m : (h + 1) * m], v[own, h * d : (h + 1) * d] * mask[own, None]
            want = (a @ (c.T @ e)) / (a @ c.sum(axis=0))[:, None]
            np.testing.assert_allclose([got[i][h * d : (h + 1) * d] for i in own.tolist()], want, atol=1e-9)


def test_the_state_is_no_column(spark):
    rows = spark.createDataFrame([(1, 1, [1.0], [1.0], [1.0])], "batch long, node long, q array<double>, k array<double>, v array<double>")
    plan = linear_attention(rows, 1, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert layout.SHARE == balance.SHARE
