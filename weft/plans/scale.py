"""Queries on what large graphs and tables need: hubs, many rounds, user aggregates, products of tables, statistics of batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.mergeable import LogSumExp, Variance
from weft.functions.vectors import batch_norm
from weft.operators import adjacency as A
from weft.operators import blocks
from weft.operators import convolutions as C
from weft.operators.aggregators import UserAggregation
from weft.operators.message_passing import MessagePassing
from weft.operators.params import dyadic, dyadic_vector
from weft.operators.stateful import BatchNormalization
from weft.operators.training import Adam, Dense, Model, Pad, gated
from weft.sources.graph import Graph

from .catalog import _gcn_filter, _on_ring, _on_segments, _on_trade, _segments, query
from .fixtures import long, ring, table, trade, vectors
from .oracle import RELU, TANH, w

# Hubs: an edge from every node to node 0 and one back. Whole weights, so that sums of hundredths don't fall between two millionths


def _hub_sql(s):
    s.add("eh", """SELECT src, dst, w FROM e UNION ALL SELECT node, 0::BIGINT, (node % 8 + 1)::DOUBLE FROM nodes WHERE node > 0
        UNION ALL SELECT 0::BIGINT, node, (node % 4 + 1)::DOUBLE FROM nodes WHERE node > 0""")


def _hub(spark, sf_dir) -> Graph:
    """The trade graph, with an edge from every node to node 0 and one back."""
    g = trade(spark, sf_dir)
    others = g.nodes.filter("node > 0")
    to = others.select(F.col("node").alias("src"), F.lit(0).cast("long").alias("dst"), (F.col("node") % 8 + 1).cast("double").alias("w"))
    back = others.select(F.lit(0).cast("long").alias("src"), F.col("node").alias("dst"), (F.col("node") % 4 + 1).cast("double").alias("w"))
    return g.with_edges(g.edges.select("src", "dst", "w").union(to).union(back))


def _on_hub(end):
    def sql(s):
        _hub_sql(s)
        return end(s)

    return _on_trade(sql)


@query("adj_matmul_hub", _on_hub(lambda s: s.long(s.adjacency("h", "x", 4, "eh"))))
def adj_matmul_hub(spark, sf_dir):
    g = _hub(spark, sf_dir)
    return long(A.adj_matmul(g.edges, g.nodes, "x", 4))


def _mp_hub_sql(s):
    s.add("m", "SELECT e.dst AS node, s.d, sum(s.v * t.v) AS v FROM eh e JOIN x s ON s.node = e.src JOIN x t ON t.node = e.dst AND t.d = s.d GROUP BY e.dst, s.d")
    return s.long(s.spread("h", "m", 4))


@query("mp_hub", _on_hub(_mp_hub_sql))
def mp_hub(spark, sf_dir):
    class Products(MessagePassing):
        def message(self, c):
            return F.zip_with(c.source("x"), c.target("x"), lambda a, b: a * b)

    return long(Products("exact_sum")(_hub(spark, sf_dir)))  # products of millionths, as in mp_edge_features


# Rounds over edges that were laid out once


def _appnp_sql(rounds: int):
    def end(s):
        s.add("nodes", "SELECT DISTINCT node FROM x")
        _gcn_filter(s, "e")
        s.dense("l", "x", 6, 1, 2, RELU)
        z = s.dense("h0", "l", 4, 3, 4)
        for k in range(rounds):
            s.adjacency(f"a{k}", z, 4, "filtered")
            z = s.zip(f"z{k}", f"a{k}", "h0", "a.v * (1 - 0.1::DOUBLE) + b.v * 0.1::DOUBLE")
        return s.long(s.each("h", z, TANH))

    return end


@query("appnp_k10", _on_ring(_appnp_sql(10)))
def appnp_k10(spark, sf_dir):
    g = ring(spark, sf_dir)
    weights = {"mlp0": dyadic(64, 6, 1), "mlp0_bias": dyadic_vector(6, 2), "mlp1": dyadic(6, 4, 3), "mlp1_bias": dyadic_vector(4, 4)}
    layer = C.APPNPConv(4, alpha=0.1, propagations=10, mlp_hidden=[6], activation="tanh", weights=weights)
    return long(layer(g.with_edges(layer.preprocess(g.edges, g.nodes))))


# Aggregates written by users


@query("aggr_variance", _on_segments(lambda s: (s.add("f", "SELECT index, d, var_pop(v) AS v FROM x GROUP BY index, d"), s.long("f", "index"))[1]))
def aggr_variance(spark, sf_dir):
    return long(UserAggregation(Variance())(_segments(spark, sf_dir), 64), ["index"])


@query("mp_variance", _on_hub(lambda s: s.long(s.spread("h", s.add("m", "SELECT e.dst AS node, d, var_pop(v) AS v FROM eh e JOIN x ON x.node = e.src GROUP BY e.dst, d"), 4))))
def mp_variance(spark, sf_dir):
    return long(MessagePassing(Variance())(_hub(spark, sf_dir)))


@query("events_log_sum_exp", lambda: "SELECT event_type, CAST(floor(ln(sum(exp(value / 100))) * 1e6 + 0.5) AS BIGINT) AS q FROM events GROUP BY event_type")
def events_log_sum_exp(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", F.array(F.col("value") / 100).alias("x"))
    out = UserAggregation(LogSumExp())(rows, 1, index="event_type")
    return out.select("event_type", F.floor(F.col("h")[0] * 1e6 + 0.5).cast("long").alias("q"))


# Dense tables times dense tables


def _cross_sql(s):
    s.each("y", "x", "v * v + 0.5")
    return s.add("g", "SELECT a.d AS node, b.d AS d, sum(a.v * b.v) AS v FROM x a JOIN y b ON a.node = b.node GROUP BY a.d, b.d")


def _sides(spark, sf_dir):
    x = vectors(spark, sf_dir).select(F.col("node").alias("row"), "x")
    return x, x.select("row", F.transform("x", lambda v: v * v + 0.5).alias("x"))


@query("dense_cross_product", _on_ring(lambda s: s.long(_cross_sql(s))))
def dense_cross_product(spark, sf_dir):
    """X' Y of two tall tables."""
    x, y = _sides(spark, sf_dir)
    return long(blocks.cross_product(x, y, 64, 64, rows=256, columns=24).withColumnRenamed("row", "node"))


@query("dense_product", _on_ring(lambda s: (_cross_sql(s), s.add("h", "SELECT x.node, g.d, sum(x.v * g.v) AS v FROM x JOIN g ON g.node = x.d GROUP BY x.node, g.d"), s.long("h"))[2]))
def dense_product(spark, sf_dir):
    """X (X' Y)."""
    x, y = _sides(spark, sf_dir)
    inner = blocks.cross_product(x, y, 64, 64, out="x")
    return long(blocks.product(x, inner, 64, 64).withColumnRenamed("row", "node"))


# Training


@query("train_gated", None)
def train_gated(spark, sf_dir):
    """Losses of three steps of training a gated model on the labels of two thirds of the vectors."""
    g = ring(spark, sf_dir)
    nodes = vectors(spark, sf_dir).withColumn("mask", F.col("node") % 3 != 0)
    steps = [Dense("first", "x", "f", 8, "relu"), Pad("f", "h", 12), *gated("g", "h", "h2", 2), Dense("last", "h2", "y", 10)]
    model = Model(steps, 64, "y", seed=1)
    losses = model.fit(g.with_features(nodes, 64), 3, Adam(rate=0.01))
    return spark.createDataFrame([(k, v) for k, v in enumerate(losses)], "step int, loss double")


# Statistics of a batch


def _batch_norm_sql(s):
    s.add("b", "SELECT d, avg(v) AS m, var_pop(v) AS s FROM x GROUP BY d")
    s.add("t", f"SELECT x.node, x.d, (x.v - b.m) / sqrt(b.s + 1e-3) * {w('x.d', 0, 1)} + {w('x.d', 0, 2)} AS v FROM x JOIN b ON b.d = x.d")
    s.add("i", f"SELECT x.node, x.d, (x.v - 0.25::DOUBLE * b.m) / sqrt(0.75::DOUBLE + 0.25::DOUBLE * b.s + 1e-3) * {w('x.d', 0, 1)} + {w('x.d', 0, 2)} AS v FROM x JOIN b ON b.d = x.d")
    return s.end("SELECT node, d::INT AS dim, CAST(floor(t.v * 1e6 + 0.5) AS BIGINT) AS q, CAST(floor(i.v * 1e6 + 0.5) AS BIGINT) AS moving FROM t JOIN i USING (node, d)")


@query("batch_norm_train", _on_ring(_batch_norm_sql))
def batch_norm_train(spark, sf_dir):
    """Normalised by the batch, and then by the statistics that have moved towards it."""
    g = ring(spark, sf_dir)
    layer = BatchNormalization(64, momentum=0.75, weights={"gamma": dyadic_vector(64, 1), "beta": dyadic_vector(64, 2)})
    trained = layer(g, draw=1)
    n = layer.weights
    both = trained.join(g.nodes.select("node", batch_norm(F.col("x"), n["mean"], n["variance"], n["gamma"], n["beta"]).alias("i")), "node")
    rows = both.select("node", F.posexplode(F.arrays_zip("h", "i")).alias("dim", "v"))
    return rows.select("node", "dim", *[F.floor(F.col("v")[c] * 1e6 + 0.5).cast("long").alias(n) for c, n in (("h", "q"), ("i", "moving"))])
