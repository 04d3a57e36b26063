"""Layers on a tiny directed, weighted graph with an isolated node, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import vectors as V
from weft.functions.segments import reducer, reducer_name, segment_softmax
from weft.operators import adjacency as A
from weft.operators import aggregators as G
from weft.operators import convolutions as C
from weft.operators import params
from weft.operators.params import from_config
from weft.operators.attention import PerformerAttention
from weft.operators.message_passing import MessagePassing
from weft.operators.norms import mean_subtraction
from weft.sources.graph import Graph, edge_index_to_adjacency, nodes_of

EDGES = [(0, 1, 1.0), (1, 2, 2.0), (2, 0, 0.5), (0, 2, 1.0), (3, 0, 1.0), (2, 2, 1.0)]
N, DIM = 5, 3
X = np.arange(N * DIM).reshape(N, DIM) / 4.0 - 1
DENSE = np.zeros((N, N))
for _s, _d, _w in EDGES:
    DENSE[_s, _d] = _w


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([(i, X[i].tolist()) for i in range(N)], "node long, x array<double>")
    return Graph(nodes, spark.createDataFrame(EDGES, "src long, dst long, w double"), DIM)


def values(df, column="h", key="node"):
    rows = df.orderBy(key).collect()
    return np.array([r[column] for r in rows], float)


def matrix(df, n=N):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r["src"], r["dst"]] += r["w"]
    return out


def test_edge_index_collapses_duplicates(spark):
    index = spark.createDataFrame([(0, 1), (0, 1), (2, 0)], "src int, dst int")
    assert sorted(map(tuple, edge_index_to_adjacency(index).collect())) == [(0, 1, 1.0), (2, 0, 1.0)]
    assert [r["node"] for r in nodes_of(edge_index_to_adjacency(index)).orderBy("node").collect()] == [0, 1, 2]
    assert nodes_of(edge_index_to_adjacency(index.limit(0))).count() == 0


def test_adjacency(graph):
    d = DENSE.sum(1)
    with np.errstate(divide="ignore"):
        p = np.where(d > 0, d**-0.5, 0)
    assert np.allclose(values(A.degrees(graph.edges, graph.nodes), "degree"), d)
    assert np.allclose(matrix(A.normalized_adjacency(graph.edges, graph.nodes)), p[:, None] * DENSE * p[None])
    assert np.allclose(matrix(A.laplacian(graph.edges, graph.nodes)), np.diag(d) - DENSE)
    loops = DENSE + np.eye(N)
    q = loops.sum(1) ** -0.5
    assert np.allclose(matrix(A.gcn_filter(graph.edges, graph.nodes)), q[:, None] * loops * q[None])
    assert loops[2, 2] == 2  # a self-loop that is there gains one
    assert np.allclose(matrix(A.matmul(graph.edges, graph.edges)), DENSE @ DENSE)


def test_products_keep_isolated_nodes(graph):
    assert np.allclose(values(A.adj_matmul(graph.edges, graph.nodes, "x", DIM)), DENSE @ X)
    assert np.allclose(values(A.adj_matmul(graph.edges, graph.nodes, "x", DIM, transpose=True)), DENSE.T @ X)


def test_message_passing_orientation_and_fill(graph):
    binary = (DENSE != 0).astype(float)
    assert np.allclose(values(MessagePassing()(graph)), binary.T @ X)
    top = values(MessagePassing("max")(graph))
    assert np.allclose(top[0], np.maximum(X[2], X[3]))
    assert (top[4] == V.LOWEST).all()


def test_user_reduction(graph):
    got = values(MessagePassing(lambda c: F.avg(c))(graph))
    assert np.allclose(got[2], (X[1] + X[0] + X[2]) / 3)
    with pytest.raises(ValueError):
        reducer("mean")
    assert reducer_name("sum") == "sum"


def test_sage(graph):
    w, r, b = (params.glorot_uniform(DIM, 2, s) for s in (1, 2, 3))
    mean = DENSE @ X / np.maximum(DENSE.sum(1), 1)[:, None]
    layer = C.SAGEConv(2, weights={"rel": w, "root": r, "bias": b[0]})
    assert np.allclose(values(layer(graph)), mean @ w + X @ r + b[0])


def softmax(x):
    e = np.exp(x - x.max())
    return e / e.sum()


@pytest.mark.parametrize("weights, expected", [([0, 0, 0], [1 / 3] * 3), ([0.5, 1, 0], [0, 1, 0]), ([2, 1, 0], [1, 0, 0]), ([0.5, 0.5, 0], [0.5, 0.5, 0])])
def test_attention_rule(spark, weights, expected):
    """Row 0's attention over three nodes is read off from one-hot features."""
    nodes = spark.createDataFrame([(i, np.eye(3)[i].tolist()) for i in range(3)], "node long, x array<double>")
    edges = spark.createDataFrame([(0, i, float(w)) for i, w in enumerate(weights)], "src long, dst long, w double")
    layer = C.GraphAttention(3, activation=None, use_bias=False, weights={"kernel0": np.eye(3), "self0": np.zeros((3, 1)), "neighbour0": np.zeros((3, 1))})
    assert np.allclose(values(layer(Graph(nodes, edges, 3)))[0], expected)


def test_attention_refuses_negative_weights(spark, graph):
    bad = graph.with_edges(graph.edges.unionByName(spark.createDataFrame([(4, 0, -1.0)], "src long, dst long, w double")))
    with pytest.raises(Exception, match="attention needs"):
        C.GraphAttention(2)(bad).collect()


def test_diffusion_matches_dense(graph):
    theta = np.array([[0.5, -0.25, 0.75], [1.0, 0.0, -0.5]])
    dense = np.stack([(np.polyval(t, DENSE) @ X).sum(1) for t in theta], 1)
    assert np.allclose(values(C.DiffuseFeatures(3, theta)(graph)), dense)


def test_gru_against_numpy(spark):
    rng = np.random.default_rng(0)
    k, r, b, c = rng.normal(size=(2, 6)), rng.normal(size=(2, 6)), rng.normal(size=6), rng.normal(size=6)
    m, h = rng.normal(size=2), rng.normal(size=2)
    sig = lambda v: 1 / (1 + np.exp(-v))
    a, s = m @ k + b, h @ r + c
    z, reset = sig(a[:2] + s[:2]), sig(a[2:4] + s[2:4])
    want = z * h + (1 - z) * np.tanh(a[4:] + reset * s[4:])
    df = spark.createDataFrame([(m.tolist(), h.tolist())], "m array<double>, h array<double>")
    assert np.allclose(df.select(V.gru(F.col("m"), F.col("h"), k, r, b, c).alias("o")).first()["o"], want)


@pytest.mark.parametrize("layer, width", [(C.APPNPConv(4, propagations=2, mlp_hidden=[6]), 4), (C.ARMAConv(4, order=2, iterations=2), 4), (C.GatedGraphConv(5, 2), 5), (C.GeneralConv(4), 4), (C.GINConv(4, mlp_hidden=[5]), 4), (C.CrystalConv(), DIM), (C.AGNNConv(), DIM), (C.DiffusionConv(4, K=3), 4), (C.GraphConvolution(4), 4), (C.GraphAttention(4, 2), 8), (C.SAGEConv(40), 40)])
def test_shapes(graph, layer, width):
    got = values(layer(graph))
    assert got.shape == (N, width)
    assert "layer" in layer.config()


def test_wide_dense_goes_through_numpy(spark):
    w = params.glorot_uniform(32, 40)
    x = np.linspace(-1, 1, 32)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    got = df.select(V.normalize(V.dense(F.col("x"), w, None, "relu")).alias("h")).first()["h"]
    want = np.maximum(x @ w, 0)
    assert np.allclose(got, want / np.linalg.norm(want))


def test_aggregators_and_gaps(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (0, [3.0, 0.0]), (3, [20.0, 40.0]), (None, [9.0, 9.0])], "index long, x array<double>")
    assert values(G.SumAggregation()(rows, 2), key="index").tolist() == [[4, 2], [0, 0], [0, 0], [20, 40]]
    assert values(G.MaxAggregation(fill=None)(rows, 2), key="index").tolist() == [[3, 2], [20, 40]]
    assert values(G.MeanAggregation()(rows, 2), key="index").tolist() == [[2, 1], [20, 40]]
    assert values(G.PowerMeanAggregation(2.0)(rows, 2), key="index")[1].tolist() == [10, 10]  # clipped twice
    assert values(G.PowerMeanAggregation(trainable=True)(rows, 2), key="index").tolist() == [[1, 1], [1, 1]]
    assert G.SumAggregation()(rows.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        G.SoftmaxAggregation(channels=2)


def test_wide_segments_are_chunked(spark):
    x = np.arange(130.0)
    rows = spark.createDataFrame([(0, x.tolist()), (0, (x * 2).tolist())], "index long, x array<double>")
    assert np.allclose(values(G.SumAggregation()(rows, 130), key="index")[0], x * 3)


def test_segment_softmax(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (1, 700.0)], "s int, v double")
    got = [r["alpha"] for r in segment_softmax(df, ["s"], "v").orderBy("s", "v").collect()]
    assert np.allclose(got, [*softmax(np.array([1.0, 2.0])), 1.0])


def test_mean_subtraction(graph):
    assert np.allclose(values(mean_subtraction(graph.nodes, DIM)).mean(axis=0), 0, atol=1e-9)


def test_performer_shape_and_mask(spark):
    rng = np.random.default_rng(1)
    rows = [(b, i, rng.normal(size=6).tolist(), True) for b in range(2) for i in range(4)]
    df = spark.createDataFrame(rows, "batch long, node long, x array<double>, mask boolean")
    out = PerformerAttention(4, 2, 8)(df, 6)
    assert out.count() == 8
    assert len(out.first()["h"]) == 4
    with pytest.raises(ValueError):
        PerformerAttention(5, 2)


def test_parameters_round_trip(spark, tmp_path):
    weights = {"a": {"kernel": params.glorot_uniform(3, 2), "bias": np.arange(2.0)}}
    params.save(spark, str(tmp_path / "w"), weights)
    back = params.load(spark, str(tmp_path / "w"))
    assert np.array_equal(back["a"]["kernel"], weights["a"]["kernel"])
    assert np.array_equal(back["a"]["bias"], weights["a"]["bias"])
    q = params.orthogonal(4, 4, 3)
    assert np.allclose(q @ q.T, np.eye(4))
    assert params.orthogonal(10, 4, 3).shape == (10, 4)


def test_graph_checks_its_input(spark, graph, tmp_path):
    with pytest.raises(ValueError):
        Graph(graph.nodes.drop("x"), graph.edges, 3)
    with pytest.raises(ValueError):
        C.GraphAttention(2, final_layer=True)
    graph.write(str(tmp_path / "n"), str(tmp_path / "e"))
    assert Graph.read(spark, str(tmp_path / "n"), str(tmp_path / "e")).dim == DIM


def test_unique_inverse(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "v string")
    values_, rows = A.unique_inverse(df, "v")
    assert {r["value"]: r["number"] for r in values_.collect()} == {"a": 0, "b": 1, "c": 2}
    assert sorted((r["v"], r["number"]) for r in rows.collect()) == [("a", 0), ("b", 1), ("b", 1), ("c", 2)]


def test_diffusion_against_dense(spark):
    """All pairs of nodes of the whole ring, by brute force."""
    from conftest import SMALL

    from weft.plans import catalog
    from weft.plans.fixtures import ring

    g = ring(spark, SMALL, 64)
    x, edges = {r["node"]: r["x"] for r in g.nodes.collect()}, g.edges.collect()
    order = sorted(x)
    at = {node: i for i, node in enumerate(order)}
    a = np.zeros((len(order), len(order)))
    for r in edges:
        a[at[r["src"]], at[r["dst"]]] = r["w"]
    p = a.sum(1) ** -0.5
    a = p[:, None] * a * p[None]
    s = np.array([sum(x[node]) for node in order])
    expected = np.stack([np.tanh(np.polyval(t, a) @ s) for t in params.dyadic(3, 3, 1).T], 1)
    got = np.full(expected.shape, np.nan)
    for r in catalog.QUERIES["diffusion"](spark, SMALL).collect():
        got[at[r["node"]], r["dim"]] = r["q"] / 1e6
    assert np.allclose(got, expected, atol=1e-6)


def test_attention_of_rows_without_edges(graph):
    """The row without edges stays: the mean of all nodes, or NaN with saliency."""
    for saliency in (False, True):
        got = values(C.GraphAttention(DIM, activation=None, use_bias=False, saliency_map_support=saliency, weights={"kernel0": np.eye(DIM), "self0": np.zeros((DIM, 1)), "neighbour0": np.zeros((DIM, 1))})(graph))
        assert got.shape == (N, DIM)
        assert not np.isnan(got[:4]).any()
        assert np.isnan(got[4]).all() if saliency else np.allclose(got[4], X.mean(0))


@pytest.mark.parametrize("name", ["gat_1head", "gat_concat", "gat_average", "gat_saliency"])
def test_attention_runs_over_all_edges(spark, name):
    from conftest import SMALL

    from weft.plans import catalog

    rows = catalog.QUERIES[name](spark, SMALL)
    assert rows.select("node").distinct().count() == 500
    assert "src % 5" not in catalog.oracle_sql()[name]


# Options of layers, stacks and long iterations


def plain_ring(spark, n=40, dim=6):
    rng = np.random.default_rng(1)
    nodes = spark.createDataFrame([(i, rng.normal(size=dim).tolist()) for i in range(n)], "node long, x array<double>")
    edges = spark.createDataFrame([(i, (i * 3 + k) % n, 1.0) for i in range(n) for k in (1, 5)], "src long, dst long, w double")
    return Graph(nodes, edges, dim)


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


@pytest.mark.parametrize("make", [lambda k: C.APPNPConv(3, propagations=k), lambda k: C.ARMAConv(3, iterations=k, share_weights=True), lambda k: C.GatedGraphConv(7, k)])
def test_plans_of_long_iterations_stay_small(spark, make):
    g = plain_ring(spark)
    few, many = make(2)(g), make(10)(g)
    assert scans(many) == scans(few) <= 6
    assert many.count() == 40


def test_configs_make_layers_again(spark):
    g = plain_ring(spark)
    layers = [C.GINConv(4, epsilon=0.5, mlp_hidden=[5], seed=3), C.APPNPConv(3, mlp_hidden=[4], propagations=2), C.GraphAttention(3, 2, "average"), C.SAGEConv(4), C.AGNNConv(beta=2.0), C.GeneralConv(3, aggregate="max")]
    for layer in layers:
        first = layer(g).collect()
        again = from_config(layer.config())
        assert type(again) is type(layer)
        assert same_rows(first, again(g).collect())
    with pytest.raises(ValueError, match="unknown layer"):
        from_config({"layer": "Nothing"})


def same_rows(a, b):
    value = lambda rows: np.array([r["h"] for r in sorted(rows, key=lambda r: r["node"])])
    return np.allclose(value(a), value(b))


def test_weights_by_initialiser(spark):
    g = plain_ring(spark)
    layer = C.SAGEConv(6, weights={"rel": "zeros", "root": lambda rows, columns, seed: np.eye(rows, columns), "bias": "ones"})
    x = {r["node"]: r["x"] for r in g.nodes.collect()}
    assert all(np.allclose(r["h"], np.array(x[r["node"]]) + 1) for r in layer(g).collect())
    with pytest.raises(ValueError, match="unknown initialiser"):
        C.SAGEConv(6, weights={"rel": "nothing"})(g)


def test_dropout_in_layers(spark):
    g = plain_ring(spark)
    for layer in (C.APPNPConv(3, mlp_hidden=[8], dropout_rate=0.5), C.ARMAConv(3, dropout_rate=0.5), C.GeneralConv(8, dropout=0.5), C.GraphAttention(3, in_dropout_rate=0.5, attn_dropout_rate=0.5)):
        plain, one, again, other = layer(g).collect(), layer(g, draw=1).collect(), layer(g, draw=1).collect(), layer(g, draw=2).collect()
        assert same_rows(one, again)
        assert not same_rows(one, plain)
        assert not same_rows(one, other)
    rows = spark.range(4000).select(F.col("id").alias("node"), V.dropout(F.array(F.lit(1.0), F.lit(2.0)), 0.25, 5).alias("h")).collect()
    h = np.array([r["h"] for r in rows])
    assert set(np.unique(h[:, 0]).round(9)) == {0.0, round(1 / 0.75, 9)}
    assert abs((h == 0).mean() - 0.25) < 0.03


def test_batch_statistics(spark):
    g = plain_ring(spark)
    x = np.array([r["x"] for r in g.nodes.collect()])
    mean, variance = V.batch_statistics(g.nodes, "x", 6)
    assert np.allclose(mean, x.mean(axis=0))
    assert np.allclose(variance, x.var(axis=0))


def test_messages_get_what_they_name(spark):
    g = plain_ring(spark)

    class Scaled(MessagePassing):
        def message(self, c, factor, shift=0.0):
            return F.transform(c.source("x"), lambda v: v * factor + shift)

    layer = Scaled()
    plain = {r["node"]: r["agg"] for r in MessagePassing().propagate(g).collect()}
    got = {r["node"]: r["agg"] for r in layer.propagate(g, factor=3.0, other=1).collect()}
    assert all(np.allclose(got[n], 3 * np.array(plain[n])) for n in plain)
    with pytest.raises(ValueError, match="factor"):
        layer.propagate(g)


def test_unique_by_first_appearance(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate("cabacdbxa")], "at int, v string").repartition(3)
    _, numbered = A.unique_inverse(rows, "v", order="at")
    assert [r["number"] for r in numbered.orderBy("at").collect()] == [0, 1, 2, 1, 0, 3, 2, 4, 1]


def test_wide_vectors_are_reduced_in_one_pass(spark):
    from weft.functions.segments import reduce_vectors

    x = np.random.default_rng(0).normal(size=(30, 150))
    df = spark.createDataFrame([(i % 3, v.tolist()) for i, v in enumerate(x)], "g int, x array<double>")
    out = reduce_vectors(df, ["g"], "x", 150, "sum", "s", [F.count(F.lit(1)).alias("n"), F.max(F.get("x", F.lit(0))).alias("m")])
    assert out.columns == ["g", "s", "n"] + ["m"]
    for r in out.collect():
        assert np.allclose(r["s"], x[r["g"] :: 3].sum(axis=0))
        assert r["n"] == 10


def test_written_tables(spark):
    from weft.sources import written as W

    t = W.written(spark.range(5))
    assert t.count() == 5
    W.clear(spark)
    with pytest.raises(Exception, match="(?i)exist|not found"):
        t.count()
    assert W.written(spark.range(3)).count() == 3
