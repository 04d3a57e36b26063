"""Queries over the driver's tables and the SQL that each can be held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import vectors as V
from weft.functions.segments import exact_mean, segment_softmax
from weft.operators import adjacency as A
from weft.operators import aggregators as G
from weft.operators import convolutions as C
from weft.operators import metrics as M
from weft.operators.attention import PerformerAttention, linear_attention
from weft.operators.message_passing import MessagePassing
from weft.operators.norms import mean_subtraction, message_norm
from weft.operators.params import dyadic, dyadic_vector
from weft.sources.graph import Graph, edge_index_to_adjacency, row_normalise

from .fixtures import long, millionths, ring, ring_edges, table, trade, trade_index, vectors
from .oracle import RELU, SIGMOID, TANH, Sql, w

QUERIES: dict = {}
_SQL: dict = {}
#: Places of an embedding.
WHOLE = 64


def query(name: str, sql):
    """Register a query and the function that writes its SQL, or None where SQL can't express it."""

    def put(f):
        QUERIES[name] = f
        _SQL[name] = sql
        return f

    return put


def oracle_sql() -> dict[str, str]:
    return {name: f() for name, f in _SQL.items() if f}


def _edges(df):
    return df.select("src", "dst", millionths(F.col("w")).alias("q"))


# Adjacency ---------------------------------------------------------------------------------------


def _on_trade(end):
    def sql():
        s = Sql()
        s.trade()
        return end(s)

    return sql


@query("edge_index_dedup", _on_trade(lambda s: s.end("SELECT DISTINCT src, dst, 1000000::BIGINT AS q FROM t")))
def edge_index_dedup(spark, sf_dir):
    return _edges(edge_index_to_adjacency(trade_index(spark, sf_dir)))


@query("source_target", _on_trade(lambda s: s.end("SELECT src, dst FROM e WHERE w - 1 <> 0")))
def source_target(spark, sf_dir):
    return A.source_target(trade(spark, sf_dir).edges.withColumn("w", F.col("w") - 1))


def _degrees_sql(s):
    s.degrees()
    return s.end("SELECT node, CAST(floor(g * 1e6 + 0.5) AS BIGINT) AS q FROM deg")


@query("degrees", _on_trade(_degrees_sql))
def degrees(spark, sf_dir):
    g = trade(spark, sf_dir)
    return A.degrees(g.edges, g.nodes).select("node", millionths(F.col("degree")).alias("q"))


def _diagonal_sql(value):
    def end(s):
        s.degrees()
        s.add("r", f"SELECT node AS src, node AS dst, {value} AS w FROM deg")
        return s.edges("r")

    return _on_trade(end)


@query("degree_matrix", _diagonal_sql("g"))
def degree_matrix(spark, sf_dir):
    g = trade(spark, sf_dir)
    return _edges(A.degree_matrix(g.edges, g.nodes))


@query("degree_power", _diagonal_sql("CASE WHEN g = 0 THEN 0.0::DOUBLE ELSE pow(g, -0.5) END"))
def degree_power(spark, sf_dir):
    g = trade(spark, sf_dir)
    return _edges(A.degree_power(g.edges, g.nodes, -0.5))


def _normalize_sql(s):
    s.degrees()
    s.add("r", "SELECT e.src, e.dst, e.w / (sqrt(p.g) + 1e-7) / (sqrt(q.g) + 1e-7) AS w FROM e JOIN deg p ON p.node = e.src JOIN deg q ON q.node = e.dst")
    return s.edges("r")


def _both_ways(s):
    """Trade edges in both directions, so that no degree is 0, and weighted differently."""
    s.add("b", "SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w / 2 FROM e UNION ALL SELECT node, node, 1.0::DOUBLE FROM nodes WHERE node % 7 = 0")
    s.degrees(edges="b")


def _both(g):
    loops = g.nodes.filter("node % 7 = 0").select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("w"))
    e = g.edges.select("src", "dst", "w")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("w") / 2).alias("w"))).unionByName(loops)


def _both_sql(end):
    def sql(s):
        _both_ways(s)
        return end(s)

    return _on_trade(sql)


def _normalize_both(s):
    s.add("r", "SELECT e.src, e.dst, e.w / (sqrt(p.g) + 1e-7) / (sqrt(q.g) + 1e-7) AS w FROM b e JOIN deg p ON p.node = e.src JOIN deg q ON q.node = e.dst")
    return s.edges("r")


@query("normalize_a", _both_sql(_normalize_both))
def normalize_a(spark, sf_dir):
    g = trade(spark, sf_dir)
    return _edges(A.normalize(_both(g), g.nodes))


@query("norm_adj_sym", _both_sql(lambda s: s.edges(s.normal("r", "b", "deg"))))
def norm_adj_sym(spark, sf_dir):
    g = trade(spark, sf_dir)
    return _edges(A.normalized_adjacency(_both(g), g.nodes))


@query("norm_adj_rw", _on_trade(lambda s: (s.degrees(), s.edges(s.normal("r", "e", "deg", False)))[1]))
def norm_adj_rw(spark, sf_dir):
    g = trade(spark, sf_dir)
    return _edges(A.normalized_adjacency(g.edges, g.nodes, symmetric=False))


def _laplacian_sql(s):
    s.add("r", "SELECT src, dst, sum(w) AS w FROM (SELECT node AS src, node AS dst, g AS w FROM deg UNION ALL SELECT src, dst, -w FROM b) GROUP BY src, dst")
    return s.edges("r")


@query("laplacian", _both_sql(_laplacian_sql))
def laplacian(spark, sf_dir):
    g = trade(spark, sf_dir)
    return _edges(A.laplacian(_both(g), g.nodes))


def _norm_laplacian_sql(s):
    s.normal("m", "b", "deg")
    s.add("r", "SELECT src, dst, sum(w) AS w FROM (SELECT node AS src, node AS dst, 1.0::DOUBLE AS w FROM nodes UNION ALL SELECT src, dst, -w FROM m) GROUP BY src, dst")
    return s.edges("r")


@query("norm_laplacian_sym", _both_sql(_norm_laplacian_sql))
def norm_laplacian_sym(spark, sf_dir):
    g = trade(spark, sf_dir)
    return _edges(A.normalized_laplacian(_both(g), g.nodes))


def _gcn_filter(s, edges="b", nodes="nodes"):
    s.add("loops", f"SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM {edges} UNION ALL SELECT node, node, 1.0::DOUBLE FROM {nodes}) GROUP BY src, dst")
    s.degrees("deg1", "loops", nodes)
    return s.normal("filtered", "loops", "deg1")


@query("gcn_filter", _both_sql(lambda s: s.edges(_gcn_filter(s))))
def gcn_filter(spark, sf_dir):
    g = trade(spark, sf_dir)
    return _edges(A.gcn_filter(_both(g), g.nodes))


# Products ----------------------------------------------------------------------------------------


def _on_ring(end, dim: int = WHOLE):
    def sql():
        s = Sql()
        s.vectors(dim)
        s.ring()
        return end(s)

    return sql


@query("adj_matmul", _on_ring(lambda s: s.long(s.adjacency("h", "x", 64)), 64))
def adj_matmul(spark, sf_dir):
    g = ring(spark, sf_dir, 64)
    return long(A.adj_matmul(g.edges, g.nodes, "x", 64))


_adj_matmul_t_places = lambda s: s.long(s.adjacency("h", "x", s.dim, transpose=True))


@query("adj_matmul_t", _on_ring(_adj_matmul_t_places))
def adj_matmul_t(spark, sf_dir, dim=WHOLE):
    g = ring(spark, sf_dir, dim)
    return long(A.adj_matmul(g.edges, g.nodes, "x", dim, transpose=True))


def _batches(nodes):
    """Two graphs' worth of features: x and x times 2, minus 1."""
    two = nodes.select(F.lit(1).cast("long").alias("batch"), "node", F.transform("x", lambda v: v * 2 - 1).alias("x"))
    return nodes.select(F.lit(0).cast("long").alias("batch"), "node", "x").unionByName(two)


def _mixed_sql(s):
    s.each("x1", "x", "v * 2 - 1")
    a, b = s.adjacency("h0", "x", s.dim), s.adjacency("h1", "x1", s.dim)
    s.add("h", f"SELECT 0::BIGINT AS batch, * FROM {a} UNION ALL SELECT 1::BIGINT, * FROM {b}")
    return s.long("h", "batch, node")


@query("modal_dot_mixed", _on_ring(_mixed_sql))
def modal_dot_mixed(spark, sf_dir, dim=WHOLE):
    g = ring(spark, sf_dir, dim)
    return long(A.adj_matmul(g.edges, _batches(g.nodes), "x", dim), ["batch", "node"])


def _batched_edges(edges):
    other = edges.select(F.lit(1).cast("long").alias("batch"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select(F.lit(0).cast("long").alias("batch"), "src", "dst", "w").unionByName(other)


def _batch_sql(s):
    s.each("x1", "x", "v * 2 - 1")
    s.add("e1", "SELECT dst AS src, src AS dst, w FROM e")
    a, b = s.adjacency("h0", "x", s.dim), s.adjacency("h1", "x1", s.dim, "e1")
    s.add("h", f"SELECT 0::BIGINT AS batch, * FROM {a} UNION ALL SELECT 1::BIGINT, * FROM {b}")
    return s.long("h", "batch, node")


@query("modal_dot_batch", _on_ring(_batch_sql))
def modal_dot_batch(spark, sf_dir, dim=WHOLE):
    g = ring(spark, sf_dir, dim)
    return long(A.adj_matmul(_batched_edges(g.edges), _batches(g.nodes), "x", dim), ["batch", "node"])


@query("matmul", _on_ring(lambda s: (s.add("r", "SELECT a.src, b.dst, sum(a.w * b.w) AS w FROM e a JOIN e b ON a.dst = b.src GROUP BY a.src, b.dst"), s.edges("r"))[1]))
def matmul(spark, sf_dir):
    e = ring_edges(spark, sf_dir)
    return _edges(A.matmul(e, e))


_polyval_places = lambda s: s.long(s.each("h", "x", "((0.5::DOUBLE * v - 1.25) * v + 2.0) * v + 0.125"))


@query("polyval", _on_ring(_polyval_places))
def polyval(spark, sf_dir, dim=WHOLE):
    x = vectors(spark, sf_dir, dim)
    return long(x.select("node", F.transform("x", lambda v: V.polyval([0.5, -1.25, 2.0, 0.125], v)).alias("h")))


@query("unique_inverse", lambda: "SELECT event_id, (dense_rank() OVER (ORDER BY user_id) - 1)::BIGINT AS number FROM events")
def unique_inverse(spark, sf_dir):
    _, rows = A.unique_inverse(table(spark, sf_dir, "events"), "user_id")
    return rows.select("event_id", F.col("number").cast("long").alias("number"))


# Segments ----------------------------------------------------------------------------------------


def _segments(spark, sf_dir, dim=WHOLE):
    """Vectors by label, with the odd numbers missing."""
    return vectors(spark, sf_dir, dim).select((F.col("label").cast("long") * 2).alias("index"), "x")


def _on_segments(end, dim: int = WHOLE):
    def sql():
        s = Sql()
        s.vectors(dim, "y")
        s.add("x", "SELECT label::BIGINT * 2 AS index, node, d, v FROM y")
        s.add("all_", f"SELECT i::BIGINT AS index, r.d FROM range((SELECT max(index) + 1 FROM x)) t(i), range({dim}) r(d)")
        return end(s)

    return sql


def _filled(s, found: str, fill: str) -> str:
    s.add("h", f"SELECT a.index, a.d, coalesce(f.v, {fill}) AS v FROM all_ a LEFT JOIN {found} f USING (index, d)")
    return s.long("h", "index")


def _reduced(how: str, fill: str | None):
    def end(s):
        s.add("f", f"SELECT index, d, {how}(v) AS v FROM x GROUP BY index, d")
        return s.long("f", "index") if fill is None else _filled(s, "f", fill)

    return end


@query("aggr_sum", _on_segments(_reduced("sum", "0.0::DOUBLE"), 64))
def aggr_sum(spark, sf_dir):
    return long(G.SumAggregation()(_segments(spark, sf_dir, 64), 64), ["index"])


@query("aggr_max", _on_segments(_reduced("max", "-1.0::DOUBLE")))
def aggr_max(spark, sf_dir, dim=WHOLE):
    return long(G.MaxAggregation(fill=-1.0)(_segments(spark, sf_dir, dim), dim), ["index"])


@query("aggr_mean", _on_segments(_reduced("avg", None)))
def aggr_mean(spark, sf_dir, dim=WHOLE):
    return long(G.MeanAggregation()(_segments(spark, sf_dir, dim), dim), ["index"])


def _softmax_sql(t: str):
    def end(s):
        s.add("a", f"SELECT index, d, v * exp({t} * v - max({t} * v) OVER (PARTITION BY d)) AS n, exp({t} * v - max({t} * v) OVER (PARTITION BY d)) AS z FROM x")
        s.add("f", "SELECT index, d, sum(n) / any_value(t) AS v FROM a JOIN (SELECT d, sum(z) AS t FROM a GROUP BY d) USING (d) GROUP BY index, d")
        return _filled(s, "f", "0.0::DOUBLE")

    return end


@query("aggr_softmax", _on_segments(_softmax_sql("2.0::DOUBLE")))
def aggr_softmax(spark, sf_dir, dim=WHOLE):
    return long(G.SoftmaxAggregation(t=2.0)(_segments(spark, sf_dir, dim), dim), ["index"])


@query("aggr_softmax_trainable", _on_segments(_softmax_sql("0.0::DOUBLE")))
def aggr_softmax_trainable(spark, sf_dir, dim=WHOLE):
    return long(G.SoftmaxAggregation(t=2.0, trainable=True)(_segments(spark, sf_dir, dim), dim), ["index"])


def _power_sql(s):
    s.add("f", "SELECT index, d, pow(least(greatest(avg(pow(least(greatest(v * 50, 0.0::DOUBLE), 100.0::DOUBLE), 2.0::DOUBLE)), 0.0::DOUBLE), 100.0::DOUBLE), 0.5::DOUBLE) AS v FROM x GROUP BY index, d")
    return s.long("f", "index")


@query("aggr_power_mean", _on_segments(_power_sql))
def aggr_power_mean(spark, sf_dir, dim=WHOLE):
    rows = _segments(spark, sf_dir, dim).select("index", F.transform("x", lambda v: v * 50).alias("x"))
    return long(G.PowerMeanAggregation(p=2.0)(rows, dim), ["index"])


def _deepsets_sql(s):
    s.add("k", "SELECT index * 1000000 + node AS node, d, v FROM x")
    s.dense("l", "k", 5, 1, 2, RELU)
    s.add("g", "SELECT node // 1000000 AS index, d, sum(v) AS v FROM l GROUP BY 1, 2")
    s.add("g1", "SELECT a.index AS node, r.d, coalesce(g.v, 0.0::DOUBLE) AS v FROM (SELECT DISTINCT index FROM all_) a CROSS JOIN range(5) r(d) LEFT JOIN g ON g.index = a.index AND g.d = r.d")
    s.dense("h", "g1", 3, 3, 4)
    s.add("h1", "SELECT node AS index, d, v FROM h")
    return s.long("h1", "index")


@query("aggr_deepsets", _on_segments(_deepsets_sql))
def aggr_deepsets(spark, sf_dir, dim=WHOLE):
    local = lambda x: V.dense(x, dyadic(dim, 5, 1), dyadic_vector(5, 2), "relu")
    last = lambda x: V.dense(x, dyadic(5, 3, 3), dyadic_vector(3, 4))
    return long(G.DeepSetsAggregation(local, last, 5)(_segments(spark, sf_dir, dim), dim), ["index"])


@query("segment_softmax", lambda: """WITH s AS (SELECT event_id, user_id, exp(value / 100 - max(value / 100) OVER (PARTITION BY user_id)) AS e FROM events)
SELECT event_id, CAST(floor(e / (sum(e) OVER (PARTITION BY user_id) + 1e-9) * 1e6 + 0.5) AS BIGINT) AS q FROM s""")
def segment_softmax_(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("value") / 100).alias("v"))
    return segment_softmax(rows, ["user_id"], "v").select("event_id", millionths(F.col("alpha")).alias("q"))


# Message passing ---------------------------------------------------------------------------------


_mp_sum_places = lambda s: s.long(s.propagate("h", "x", s.dim))


@query("mp_sum", _on_ring(_mp_sum_places))
def mp_sum(spark, sf_dir, dim=WHOLE):
    return long(MessagePassing()(ring(spark, sf_dir, dim)))


@query("mp_max", _on_trade(lambda s: s.long(s.spread("h", s.add("m", "SELECT e.dst AS node, d, max(2 * v) AS v FROM e JOIN x ON x.node = e.src GROUP BY e.dst, d"), 4, "-1.0::DOUBLE"))))
def mp_max(spark, sf_dir):
    class Doubled(MessagePassing):
        def message(self, c):
            return F.transform(c.source("x"), lambda v: v * 2)

        def fill(self):
            return -1.0

    return long(Doubled("max")(trade(spark, sf_dir)))


def _mp_edges_sql(s):
    s.add("m", """SELECT e.dst AS node, d, sum(CASE d WHEN 0 THEN e0 * s.v ELSE e1 * (s.v - t.v) END) AS v
        FROM e JOIN x s ON s.node = e.src JOIN x t ON t.node = e.dst AND t.d = s.d WHERE s.d < 2 GROUP BY e.dst, s.d""".replace("AS node, d,", "AS node, s.d,").replace("CASE d", "CASE s.d"))
    s.spread("h", "m", 2)
    return s.long(s.each("h1", "h", "v + 1"))


@query("mp_edge_features", _on_trade(_mp_edges_sql))
def mp_edge_features(spark, sf_dir):
    class WithEdges(MessagePassing):
        def message(self, c):
            e, s, t = c.edge("e"), c.source("x"), c.target("x")
            return F.array(e[0] * s[0], e[1] * (s[1] - t[1]))

        def message_dim(self, graph):
            return 2

        def update(self, h):
            return F.transform(h, lambda v: v + 1)

    # sums of hundredths of millionths often lie midway between two millionths, where the order of a plain sum decides
    return long(WithEdges("exact_sum")(trade(spark, sf_dir, exact_mean)))


# Convolutions ------------------------------------------------------------------------------------


def _sage_sql(s, dim=64):
    s.adjacency("ax", "x", dim)
    s.add("deg", "SELECT src AS node, sum(w) AS g FROM e GROUP BY src")
    s.add("m", "SELECT a.node, a.d, a.v / greatest(coalesce(g, 0.0::DOUBLE), 1.0::DOUBLE) AS v FROM ax a LEFT JOIN deg ON deg.node = a.node")
    s.dense("p", "m", 8, 1)
    s.dense("q", "x", 8, 2, 3)
    return s.zip("h", "p", "q", "a.v + b.v")


def _sage(**how):
    return C.SAGEConv(8, weights={"rel": dyadic(64, 8, 1), "root": dyadic(64, 8, 2), "bias": dyadic_vector(8, 3)}, **how)


@query("sage", _on_ring(lambda s: s.long(_sage_sql(s)), 64))
def sage(spark, sf_dir):
    return long(_sage()(ring(spark, sf_dir, 64)))


@query("sage_normalized", _on_ring(lambda s: s.long(s.add("u1", f"SELECT node, d, v * (node % 3) AS v FROM {s.unit('u', _sage_sql(s))}")), 64))
def sage_normalized(spark, sf_dir):
    g = ring(spark, sf_dir, 64)
    return long(_sage(normalize=True)(g.with_features(g.nodes.withColumn("mask", F.col("node") % 3), 64)))


def _agnn_sql(s):
    s.unit("n", "x")
    s.add("l", "SELECT e.src, e.dst, sum(a.v * b.v) AS l FROM e JOIN n a ON a.node = e.src JOIN n b ON b.node = e.dst AND a.d = b.d GROUP BY e.src, e.dst")
    s.add("p", "SELECT src, dst, exp(l - max(l) OVER (PARTITION BY dst)) AS p FROM l")
    s.add("al", "SELECT src, dst, p / (sum(p) OVER (PARTITION BY dst) + 1e-9) AS w FROM p")
    return s.long(s.adjacency("h", "x", s.dim, "al", True))


@query("agnn", _on_ring(_agnn_sql))
def agnn(spark, sf_dir, dim=WHOLE):
    return long(C.AGNNConv()(ring(spark, sf_dir, dim)))


def _agnn_max_sql(s):
    _agnn_sql(s)
    s.add("hm", "SELECT al.dst AS node, x.d, max(al.w * x.v) AS v FROM al JOIN x ON x.node = al.src GROUP BY al.dst, x.d")
    return s.long(s.each("ht", s.spread("hs", "hm", s.dim, "-3.4028234663852886e38::DOUBLE"), TANH))


@query("agnn_max", _on_ring(_agnn_max_sql))
def agnn_max(spark, sf_dir, dim=WHOLE):
    return long(C.AGNNConv(aggregate="max", activation="tanh")(ring(spark, sf_dir, dim)))


def _appnp_sql(s):
    s.add("nodes", "SELECT DISTINCT node FROM x")
    _gcn_filter(s, "e")
    s.dense("l", "x", 6, 1, 2, RELU)
    s.dense("h0", "l", 4, 3, 4)
    z = "h0"
    for k in range(3):
        s.adjacency(f"a{k}", z, 4, "filtered")
        z = s.zip(f"z{k}", f"a{k}", "h0", "a.v * (1 - 0.2::DOUBLE) + b.v * 0.2::DOUBLE")
    return s.long(s.each("h", z, TANH))


@query("appnp_k3", _on_ring(_appnp_sql))
def appnp_k3(spark, sf_dir, dim=WHOLE):
    g = ring(spark, sf_dir, dim)
    weights = {"mlp0": dyadic(dim, 6, 1), "mlp0_bias": dyadic_vector(6, 2), "mlp1": dyadic(6, 4, 3), "mlp1_bias": dyadic_vector(4, 4)}
    layer = C.APPNPConv(4, propagations=3, mlp_hidden=[6], activation="tanh", weights=weights)
    return long(layer(g.with_edges(layer.preprocess(g.edges, g.nodes))))


def _arma_sql(shared: bool):
    def end(s):
        s.add("nodes", "SELECT DISTINCT node FROM x")
        s.degrees()
        s.normal("a", "e", "deg")
        tops = []
        for k in range(2):
            x, width = "x", 8
            for i in range(3 if shared else 2):
                at = min(i, 1) if shared else i
                s.dense(f"xw{k}{i}", x, 4, 10 * k + at)
                s.adjacency(f"ax{k}{i}", f"xw{k}{i}", 4, "a")
                s.dense(f"sk{k}{i}", "x", 4, 30 + 10 * k + at, 60 + 10 * k + at)
                s.zip(f"s{k}{i}", f"ax{k}{i}", f"sk{k}{i}", "a.v + b.v")
                x = s.each(f"y{k}{i}", f"s{k}{i}", RELU)
            tops.append(x)
        s.zip("mean", *tops, "(a.v + b.v) / 2.0")
        return s.long(s.each("h", "mean", TANH))

    return end


def _arma(spark, sf_dir, dim: int, iterations: int, shared: bool):
    g = ring(spark, sf_dir, dim)
    weights = {}
    for k in range(2):
        for at in range(2):
            weights[f"w1_{k}_{at}"] = dyadic(dim if at == 0 else 4, 4, 10 * k + at)
            weights[f"w2_{k}_{at}"], weights[f"b_{k}_{at}"] = dyadic(dim, 4, 30 + 10 * k + at), dyadic_vector(4, 60 + 10 * k + at)
    layer = C.ARMAConv(4, order=2, iterations=iterations, share_weights=shared, activation="tanh", weights=weights)
    return long(layer(g.with_edges(layer.preprocess(g.edges, g.nodes))))


@query("arma_k2_t2", _on_ring(_arma_sql(False)))
def arma_k2_t2(spark, sf_dir, dim=WHOLE):
    return _arma(spark, sf_dir, dim, 2, False)


@query("arma_shared", _on_ring(_arma_sql(True)))
def arma_shared(spark, sf_dir, dim=WHOLE):
    return _arma(spark, sf_dir, dim, 3, True)


def _crystal_sql(s):
    s.add("z", """SELECT e.src, e.dst, d, v FROM (SELECT e.src, e.dst, t.d, t.v FROM e JOIN x t ON t.node = e.dst UNION ALL SELECT e.src, e.dst, s.d + 4, s.v FROM e JOIN x s ON s.node = e.src
        UNION ALL SELECT src, dst, 8, e0 FROM e UNION ALL SELECT src, dst, 9, e1 FROM e) e""")
    part = lambda seed, bias: f"SELECT src, dst, i AS d, sum(v * {w('i', 'd', seed)}) + {w('i', 0, bias)} AS v FROM z, range(4) o(i) GROUP BY src, dst, i"
    s.add("p", part(1, 2))
    s.add("q", part(3, 4))
    s.add("m", f"SELECT p.dst AS node, p.d, sum({TANH.replace('v', 'p.v')} * {SIGMOID.replace('-v', '-q.v')}) AS v FROM p JOIN q USING (src, dst, d) GROUP BY p.dst, p.d".replace("JOIN q USING (src, dst, d)", "JOIN q ON p.src = q.src AND p.dst = q.dst AND p.d = q.d"))
    s.spread("m1", "m", 4)
    return s.long(s.zip("h", "m1", "x", "a.v + b.v"))


@query("crystal", _on_trade(_crystal_sql))
def crystal(spark, sf_dir):
    weights = {"s": dyadic(10, 4, 1), "s_bias": dyadic_vector(4, 2), "f": dyadic(10, 4, 3), "f_bias": dyadic_vector(4, 4)}
    return long(C.CrystalConv(activation="tanh", edge_dim=2, weights=weights)(trade(spark, sf_dir)))


def _diffusion_sql(s):
    """Absent edges count with the last coefficient: it times the sum over all nodes, and edges add what they differ by."""
    s.add("nodes", "SELECT DISTINCT node FROM x")
    s.add("s", "SELECT node, sum(v) AS s FROM x GROUP BY node")
    s.degrees()
    s.normal("a", "e", "deg", True)
    poly = f"(({w('c', 0, 1)} * w + {w('c', 1, 1)}) * w)"
    s.add("m", f"SELECT a.src AS node, c AS d, sum({poly} * s.s) AS v FROM a JOIN s ON s.node = a.dst, range(3) r(c) GROUP BY a.src, c")
    s.spread("met", "m", 3)
    s.add("h", f"SELECT node, d, tanh(v + {w('d', 2, 1)} * (SELECT sum(s) FROM s)) AS v FROM met")
    return s.long("h")


@query("diffusion", _on_ring(_diffusion_sql))
def diffusion(spark, sf_dir):
    g = ring(spark, sf_dir, 64)
    layer = C.DiffusionConv(3, K=2, thetas=dyadic(3, 3, 1).T)
    return long(layer(g.with_edges(layer.preprocess(g.edges, g.nodes))))


def _gru_sql(s, name, m, h, c):
    s.dense(f"{name}a", m, 3 * c, 5, 6)
    s.dense(f"{name}r", h, 3 * c, 7, 8)
    gate = lambda k: f"1.0::DOUBLE / (1.0::DOUBLE + exp(-(a.v + b.v))) AS v FROM {name}a a JOIN {name}r b ON a.node = b.node AND a.d = b.d WHERE a.d >= {k * c} AND a.d < {(k + 1) * c}"
    s.add(f"{name}z", f"SELECT a.node, a.d AS d, {gate(0)}")
    s.add(f"{name}g", f"SELECT a.node, a.d - {c} AS d, {gate(1)}")
    s.add(f"{name}c", f"SELECT g.node, g.d, tanh(a.v + g.v * b.v) AS v FROM {name}g g JOIN {name}a a ON a.node = g.node AND a.d = g.d + {2 * c} JOIN {name}r b ON b.node = g.node AND b.d = g.d + {2 * c}")
    return s.add(name, f"SELECT z.node, z.d, z.v * h.v + (1.0::DOUBLE - z.v) * c.v AS v FROM {name}z z JOIN {name}c c ON c.node = z.node AND c.d = z.d JOIN {h} h ON h.node = z.node AND h.d = z.d")


def _gated_sql(s):
    places, c = s.dim, s.dim + 2
    s.add("xp", f"SELECT node, d, v FROM x WHERE d < {places} UNION ALL SELECT DISTINCT node, r.d, 0.0::DOUBLE FROM x, range({places}, {c}) r(d)")
    h = "xp"
    for k in range(2):
        s.dense(f"sent{k}", h, c, 1 + k)
        s.propagate(f"got{k}", f"sent{k}", c)
        h = _gru_sql(s, f"h{k}", f"got{k}", h, c)
    return s.long(h)


@query("gated_graph_l2", _on_ring(_gated_sql))
def gated_graph_l2(spark, sf_dir, dim=WHOLE):
    g, c = Graph(vectors(spark, sf_dir, dim).select("node", "x"), ring_edges(spark, sf_dir), dim), dim + 2
    weights = {"w0": dyadic(c, c, 1), "w1": dyadic(c, c, 2), "kernel": dyadic(c, 3 * c, 5), "recurrent": dyadic(c, 3 * c, 7), "gru_bias": dyadic_vector(3 * c, 6), "gru_recurrent_bias": dyadic_vector(3 * c, 8)}
    return long(C.GatedGraphConv(c, 2, weights=weights)(g))


def _gcn_sql(s):
    s.each("x1", "x", "v * 2 - 1")
    s.add("e1", "SELECT dst AS src, src AS dst, w FROM e")
    for k, (x, e) in enumerate((("x", "e"), ("x1", "e1"))):
        s.adjacency(f"ax{k}", x, s.dim, e, True)
        s.dense(f"h{k}", f"ax{k}", 4, 1, 2, RELU)
    s.add("h", "SELECT 0::BIGINT AS batch, * FROM h0 UNION ALL SELECT 1::BIGINT, * FROM h1")
    return s.long("h", "batch, node")


@query("gcn_batched", _on_ring(_gcn_sql))
def gcn_batched(spark, sf_dir, dim=WHOLE):
    g = ring(spark, sf_dir, dim)
    g = Graph(_batches(g.nodes), _batched_edges(g.edges), dim)
    return long(C.GraphConvolution(4, "relu", weights={"kernel": dyadic(dim, 4, 1), "bias": dyadic_vector(4, 2)})(g), ["batch", "node"])


def _general_sql(s):
    s.dense("l", "x", 6, 1, 2)
    s.add("b", f"SELECT node, d, (v - {w('d', 0, 3)}) / sqrt(1.0::DOUBLE + {w('d', 0, 4)} * {w('d', 0, 4)} + 1e-3) * {w('d', 0, 5)} + {w('d', 0, 6)} AS v FROM l")
    s.add("p", f"SELECT node, d, greatest(v, 0.0::DOUBLE) + {w('d', 0, 7)} * least(v, 0.0::DOUBLE) AS v FROM b")
    return s.long(s.propagate("h", "p", 6))


@query("general_conv", _on_ring(_general_sql))
def general_conv(spark, sf_dir, dim=WHOLE):
    weights = {"kernel": dyadic(dim, 6, 1), "bias": dyadic_vector(6, 2), "mean": dyadic_vector(6, 3), "variance": 1 + dyadic_vector(6, 4) ** 2, "gamma": dyadic_vector(6, 5), "beta": dyadic_vector(6, 6), "slope": dyadic_vector(6, 7)}
    return long(C.GeneralConv(6, weights=weights)(ring(spark, sf_dir, dim)))


def _gin_sql(s):
    s.propagate("m", "x", s.dim)
    s.zip("z", "x", "m", "a.v * 1.25::DOUBLE + b.v")
    s.dense("l", "z", 6, 1, 2, RELU)
    s.each("b", "l", "v / sqrt(1.0::DOUBLE + 1e-3)")
    return s.long(s.dense("h", "b", 4, 3, 4, TANH))


@query("gin", _on_ring(_gin_sql))
def gin(spark, sf_dir, dim=WHOLE):
    weights = {"mlp0": dyadic(dim, 6, 1), "mlp0_bias": dyadic_vector(6, 2), "mlp1": dyadic(6, 4, 3), "mlp1_bias": dyadic_vector(4, 4)}
    return long(C.GINConv(4, epsilon=0.25, mlp_hidden=[6], activation="tanh", weights=weights)(ring(spark, sf_dir, dim)))


def _gat_sql(heads: int, average: bool = False, saliency: bool = False):
    def end(s):
        s.add("nodes", "SELECT DISTINCT node FROM x")
        if saliency:
            s.add("kept", "SELECT src, dst, w, 1.0::DOUBLE AS top FROM e")
        else:
            s.add("tops", "SELECT src, dst, w, max(w) OVER (PARTITION BY src) AS top FROM e")
            s.add("kept", "SELECT * FROM tops WHERE w = top")
        outs = []
        for k in range(heads):
            f = s.dense(f"f{k}", "x", 4, 1 + k)
            s.dense(f"a{k}", f, 1, 11 + k)
            s.dense(f"b{k}", f, 1, 21 + k)
            s.add(f"l{k}", f"SELECT src, dst, w, CASE WHEN top = 1 THEN CASE WHEN a.v + b.v > 0 THEN a.v + b.v ELSE (a.v + b.v) * 0.2::DOUBLE END ELSE 0.0::DOUBLE END AS l FROM kept JOIN a{k} a ON a.node = src JOIN b{k} b ON b.node = dst")
            s.add(f"p{k}", f"SELECT src, dst, {'w * ' if saliency else ''}exp(l - max(l) OVER (PARTITION BY src)) AS p FROM l{k}")
            s.add(f"w{k}", f"SELECT src, dst, p / sum(p) OVER (PARTITION BY src) AS w FROM p{k}")
            s.add(f"h{k}_m", f"SELECT a.src AS node, r.d, sum(a.w * r.v) AS v FROM w{k} a JOIN {f} r ON r.node = a.dst GROUP BY a.src, r.d")
            s.add(f"m{k}", f"SELECT d, avg(v) AS v FROM {f} GROUP BY d")
            s.add(f"o{k}", f"SELECT n.node, m.d, coalesce(h.v, m.v) + {w('m.d', 0, 31 + k)} AS v FROM nodes n CROSS JOIN m{k} m LEFT JOIN h{k}_m h ON h.node = n.node AND h.d = m.d")
            outs.append(f"SELECT node, d + {0 if average else 4 * k} AS d, v FROM o{k}")
        s.add("u", " UNION ALL ".join(outs))
        s.add("h", f"SELECT node, d, tanh(sum(v) / {heads if average else 1}) AS v FROM u GROUP BY node, d")
        return s.long("h")

    return _on_ring(end)


def _gat(spark, sf_dir, heads, reduction="concat", saliency=False):
    g = ring(spark, sf_dir)
    weights = {}
    for k in range(heads):
        weights |= {f"kernel{k}": dyadic(g.dim, 4, 1 + k), f"self{k}": dyadic(4, 1, 11 + k), f"neighbour{k}": dyadic(4, 1, 21 + k), f"bias{k}": dyadic_vector(4, 31 + k)}
    layer = C.GraphAttention(4, heads, reduction, "tanh", saliency_map_support=saliency, weights=weights)
    return long(layer(g))


@query("gat_1head", _gat_sql(1))
def gat_1head(spark, sf_dir):
    return _gat(spark, sf_dir, 1)


@query("gat_concat", _gat_sql(2))
def gat_concat(spark, sf_dir):
    return _gat(spark, sf_dir, 2)


@query("gat_average", _gat_sql(2, average=True))
def gat_average(spark, sf_dir):
    return _gat(spark, sf_dir, 2, "average")


@query("gat_saliency", _gat_sql(1, saliency=True))
def gat_saliency(spark, sf_dir):
    return _gat(spark, sf_dir, 1, saliency=True)


def _ppnp_sql(s):
    s.add("nodes", "SELECT DISTINCT node FROM x")
    _gcn_filter(s, "e")
    return s.long(s.adjacency("h", "x", s.dim, "filtered"))


@query("ppnp", _on_ring(_ppnp_sql))
def ppnp(spark, sf_dir, dim=WHOLE):
    g = ring(spark, sf_dir, dim)
    return long(C.ppnp_propagation(A.gcn_filter(g.edges, g.nodes), g.nodes, "x", dim))


# Norms, attention --------------------------------------------------------------------------------


@query("mean_subtraction", _on_ring(lambda s: s.long(s.add("h", "SELECT node, d, v - m AS v FROM x JOIN (SELECT d, avg(v) AS m FROM x GROUP BY d) USING (d)")), 64))
def mean_subtraction_(spark, sf_dir):
    return long(mean_subtraction(vectors(spark, sf_dir, 64).select("node", "x"), 64))


def _message_norm_sql(s):
    s.propagate("m", "x", s.dim)
    s.unit("a", "m")
    s.unit("b", "x")
    return s.long(s.zip("h", "a", "b", "a.v * b.v * 1.5::DOUBLE"))


@query("message_norm", _on_ring(_message_norm_sql))
def message_norm_(spark, sf_dir, dim=WHOLE):
    g = ring(spark, sf_dir, dim)
    return long(message_norm(g.nodes, MessagePassing()(g).withColumnRenamed("h", "msg"), scale=1.5))


def _attend(s, q: str, k: str, v: str, d: int, out: str) -> str:
    s.add(f"{out}_s", f"SELECT l.label, k.d AS r, v.d AS c, sum(k.v * v.v) AS kv FROM {k} k JOIN {v} v ON k.node = v.node JOIN lab l ON l.node = k.node GROUP BY 1, 2, 3")
    s.add(f"{out}_k", f"SELECT l.label, k.d AS r, sum(k.v) AS k FROM {k} k JOIN lab l ON l.node = k.node GROUP BY 1, 2")
    s.add(f"{out}_t", f"SELECT q.node, c AS d, sum(q.v * kv) AS v FROM {q} q JOIN lab l ON l.node = q.node JOIN {out}_s s ON s.label = l.label AND s.r = q.d GROUP BY q.node, c")
    s.add(f"{out}_b", f"SELECT q.node, sum(q.v * k) AS v FROM {q} q JOIN lab l ON l.node = q.node JOIN {out}_k s ON s.label = l.label AND s.r = q.d GROUP BY q.node")
    return s.add(out, f"SELECT t.node, t.d, t.v / b.v AS v FROM {out}_t t JOIN {out}_b b ON t.node = b.node")


def _linear_sql(s):
    s.add("lab", "SELECT DISTINCT node, label FROM x")
    s.each("q", "x", "v * v + 0.5")
    s.each("k", "x", "abs(v) + 0.25")
    s.add("vv", "SELECT node, d, CASE WHEN node % 4 = 0 THEN 0.0::DOUBLE ELSE v END AS v FROM x")
    _attend(s, "q", "k", "vv", s.dim, "h0")
    s.add("h", "SELECT label::BIGINT AS batch, h0.node, h0.d, h0.v FROM h0 JOIN lab ON lab.node = h0.node")
    return s.long("h", "batch, node")


@query("linear_attention", _on_ring(_linear_sql))
def linear_attention_(spark, sf_dir, dim=WHOLE):
    x = vectors(spark, sf_dir, dim)
    rows = x.select(F.col("label").cast("long").alias("batch"), "node", F.transform("x", lambda v: v * v + 0.5).alias("q"), F.transform("x", lambda v: F.abs(v) + 0.25).alias("k"), F.col("x").alias("v"), (F.col("node") % 4 != 0).alias("mask"))
    return long(linear_attention(rows, dim, dim), ["batch", "node"])


def _performer_sql(s):
    s.add("lab", "SELECT DISTINCT node, label FROM x")
    for name, seed in (("q", 1), ("k", 2), ("v", 3)):
        s.dense(name, "x", 8, seed)
    heads = []
    for h in range(2):
        for name in ("q", "k"):
            s.add(f"{name}{h}", f"SELECT node, d - {4 * h} AS d, v FROM {name} WHERE d >= {4 * h} AND d < {4 * h + 4}")
            s.add(f"{name}f{h}", f"SELECT node, i AS d, greatest(sum(v * {w('d', 'i', 4)}), 0.0::DOUBLE) + 0.001::DOUBLE AS v FROM {name}{h}, range(5) o(i) GROUP BY node, i")
        s.add(f"v{h}", f"SELECT node, d - {4 * h} AS d, v FROM v WHERE d >= {4 * h} AND d < {4 * h + 4}")
        heads.append(f"SELECT node, d + {4 * h} AS d, v FROM {_attend(s, f'qf{h}', f'kf{h}', f'v{h}', 4, f'o{h}')}")
    s.add("cat", " UNION ALL ".join(heads))
    s.dense("h0", "cat", 6, 5, 6)
    s.add("h", "SELECT label::BIGINT AS batch, h0.node, h0.d, h0.v FROM h0 JOIN lab ON lab.node = h0.node")
    return s.long("h", "batch, node")


@query("performer", _on_ring(_performer_sql))
def performer(spark, sf_dir, dim=WHOLE):
    x = vectors(spark, sf_dir, dim).select(F.col("label").cast("long").alias("batch"), "node", "x")
    weights = {"q": dyadic(dim, 8, 1), "k": dyadic(dim, 8, 2), "v": dyadic(dim, 8, 3), "out": dyadic(8, 6, 5), "out_bias": dyadic_vector(6, 6), "projection": dyadic(5, 4, 4)}
    return long(PerformerAttention(6, 2, 4, weights=weights)(x, dim), ["batch", "node"])


# Heads and metrics -------------------------------------------------------------------------------


_row_normalise_places = lambda s: s.long(s.add("h", "SELECT node, d, v / sum(abs(v)) OVER (PARTITION BY node) AS v FROM x"))


@query("row_normalise", _on_ring(_row_normalise_places))
def row_normalise_(spark, sf_dir, dim=WHOLE):
    return long(row_normalise(vectors(spark, sf_dir, dim).select("node", "x")), h="x")


_log_softmax_places = lambda s: s.long(s.add("h", "SELECT node, d, v - m - ln(sum(exp(v - m)) OVER (PARTITION BY node)) AS v FROM (SELECT node, d, v, max(v) OVER (PARTITION BY node) AS m FROM x)"))


@query("log_softmax", _on_ring(_log_softmax_places))
def log_softmax(spark, sf_dir, dim=WHOLE):
    return long(vectors(spark, sf_dir, dim).select("node", V.log_softmax(F.col("x")).alias("h")))


_softmax_places = lambda s: s.long(s.add("h", "SELECT node, d, exp(v) / sum(exp(v)) OVER (PARTITION BY node) AS v FROM x"))


@query("softmax", _on_ring(_softmax_places))
def softmax(spark, sf_dir, dim=WHOLE):
    return long(vectors(spark, sf_dir, dim).select("node", V.softmax(F.col("x")).alias("h")))


_TEN = "SELECT node, label, d, v FROM x WHERE d < 10"


@query("argmax_pred", _on_ring(lambda s: (s.add("t", _TEN), s.end("SELECT node, min_by(d, d)::INT AS pred FROM (SELECT *, max(v) OVER (PARTITION BY node) AS m FROM t) WHERE v = m GROUP BY node"))[1], 10))
def argmax_pred(spark, sf_dir):
    return M.predictions(vectors(spark, sf_dir, 10), "x").select("node", "pred")


@query("masked_accuracy", _on_ring(lambda s: (s.add("t", "SELECT * FROM (SELECT node, label, d, v, max(v) OVER (PARTITION BY node) AS m FROM x) WHERE v = m AND node % 3 = 0"), s.end("SELECT CAST(floor(avg(CASE WHEN d = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 1e6 + 0.5) AS BIGINT) AS q FROM t"))[1], 10))
def masked_accuracy(spark, sf_dir):
    rows = vectors(spark, sf_dir, 10).withColumn("mask", F.col("node") % 3 == 0)
    return M.accuracy(M.masked(rows), "x").select(millionths(F.col("accuracy")).alias("q"))


@query("cross_entropy", _on_ring(lambda s: (s.add("t", "SELECT node, label, d, v - ln(sum(exp(v)) OVER (PARTITION BY node)) AS l FROM x"), s.end("SELECT CAST(floor(avg(-l) * 1e6 + 0.5) AS BIGINT) AS q FROM t WHERE d = label"))[1], 10))
def cross_entropy(spark, sf_dir):
    return M.cross_entropy(vectors(spark, sf_dir, 10), "x").select(millionths(F.col("loss")).alias("q"))


# Models: layers on top of each other, as in node classification ------------------------------------


def _arma_layer_sql(s, tag: str, x: str, width: int, c: int, seed: int, act: str):
    """One ARMA layer of one stack and one iteration."""
    s.dense(f"{tag}w", x, c, seed)
    s.adjacency(f"{tag}a", f"{tag}w", c, "a")
    s.dense(f"{tag}s", x, c, seed + 1, seed + 2)
    s.zip(f"{tag}z", f"{tag}a", f"{tag}s", "a.v + b.v")
    return s.each(tag, s.each(f"{tag}r", f"{tag}z", RELU), act)


def _batch_norm_sql(s, tag: str, x: str):
    return s.add(tag, f"SELECT node, d, (v - {w('d', 0, 91)}) / sqrt(1.0::DOUBLE + {w('d', 0, 92)} * {w('d', 0, 92)} + 1e-3) * {w('d', 0, 93)} + {w('d', 0, 94)} AS v FROM {x}")


def _arma_model_sql(s):
    s.add("nodes", "SELECT DISTINCT node FROM x")
    s.degrees()
    s.normal("a", "e", "deg")
    h = _batch_norm_sql(s, "n1", _arma_layer_sql(s, "l1", "x", 64, 6, 1, RELU))
    h = _batch_norm_sql(s, "n2", _arma_layer_sql(s, "l2", h, 6, 6, 4, RELU))
    h = _arma_layer_sql(s, "l3", h, 6, 4, 7, "v")
    return s.long(s.add("h", f"SELECT node, d, exp(v) / sum(exp(v)) OVER (PARTITION BY node) AS v FROM {h}"))


@query("model_arma", _on_ring(_arma_model_sql))
def model_arma(spark, sf_dir):
    """Three ARMA layers with batch normalisation between them, and a softmax."""
    g = ring(spark, sf_dir)
    g = g.with_edges(A.normalized_adjacency(g.edges, g.nodes))
    weights = lambda dim, c, seed: {"w1_0_0": dyadic(dim, c, seed), "w2_0_0": dyadic(dim, c, seed + 1), "b_0_0": dyadic_vector(c, seed + 2)}
    norm = (dyadic_vector(6, 91), 1 + dyadic_vector(6, 92) ** 2, dyadic_vector(6, 93), dyadic_vector(6, 94))
    normal = lambda g: g.with_features(g.nodes.withColumn("x", V.batch_norm(F.col("x"), *norm)), g.dim)
    g = normal(g.through(C.ARMAConv(6, activation="relu", weights=weights(64, 6, 1)), 6))
    g = normal(g.through(C.ARMAConv(6, activation="relu", weights=weights(6, 6, 4)), 6))
    return long(C.ARMAConv(4, activation="softmax", weights=weights(6, 4, 7))(g))


def _gated_layers_sql(s, tag: str, h: str, c: int, layers: int, seed: int):
    for k in range(layers):
        s.dense(f"{tag}s{k}", h, c, seed + k)
        s.propagate(f"{tag}m{k}", f"{tag}s{k}", c)
        h = _gru_sql(s, f"{tag}h{k}", f"{tag}m{k}", h, c)
    return h


def _gated_model_sql(s):
    s.dense("first", "x", 5, 41, 42, RELU)
    s.add("xp", "SELECT node, d, v FROM first UNION ALL SELECT DISTINCT node, r.d, 0.0::DOUBLE FROM first, range(5, 7) r(d)")
    h = _gated_layers_sql(s, "p", "xp", 7, 3, 51)
    h = _gated_layers_sql(s, "q", h, 7, 2, 61)
    s.dense("last", h, 4, 43, 44)
    return s.long(s.add("h", "SELECT node, d, v - m - ln(sum(exp(v - m)) OVER (PARTITION BY node)) AS v FROM (SELECT node, d, v, max(v) OVER (PARTITION BY node) AS m FROM last)"))


@query("model_gated", _on_ring(_gated_model_sql))
def model_gated(spark, sf_dir):
    """A dense layer, two gated layers of three and two steps, a dense layer, and a log-softmax."""
    g = ring(spark, sf_dir)
    g = g.with_features(g.nodes.withColumn("x", V.dense(F.col("x"), dyadic(64, 5, 41), dyadic_vector(5, 42), "relu")), 5)
    cell = {"kernel": dyadic(7, 21, 5), "recurrent": dyadic(7, 21, 7), "gru_bias": dyadic_vector(21, 6), "gru_recurrent_bias": dyadic_vector(21, 8)}
    for layers, seed in ((3, 51), (2, 61)):
        g = g.through(C.GatedGraphConv(7, layers, weights=cell | {f"w{k}": dyadic(7, 7, seed + k) for k in range(layers)}), 7)
    return long(g.nodes.select("node", V.log_softmax(V.dense(F.col("x"), dyadic(7, 4, 43), dyadic_vector(4, 44))).alias("h")))


from . import scale  # noqa: E402, F401  registers its queries
