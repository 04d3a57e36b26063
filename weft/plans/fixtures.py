"""Graphs and vectors over the driver's tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.sources.graph import Graph
from weft.sources.written import written

SUPPLIERS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark, sf_dir, dim: int = 64) -> DataFrame:
    """(node, x, label) of the embeddings; of their first places where fewer are asked for (as many as there are classes)."""
    x = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("node"), (x if dim == 64 else F.slice(x, 1, dim)).alias("x"), F.col("label").cast("int").alias("label"))


def ring_edges(spark, sf_dir, weighted: bool = True) -> DataFrame:
    """Five edges out of each vector to scattered others; directed, asymmetric, weights of 1/4 to 1."""
    nodes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("src"))
    n = F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n")))
    edges = nodes.crossJoin(n).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(4))))
    edges = edges.select("src", ((F.col("src") * 7 + F.col("k") * 131 + 1) % F.col("n")).alias("dst")).distinct()
    return edges.withColumn("w", (((F.col("src") + 2 * F.col("dst")) % 4 + 1) / 4.0).cast("double") if weighted else F.lit(1.0))


def ring(spark, sf_dir, dim: int = 64, weighted: bool = True) -> Graph:
    return Graph(vectors(spark, sf_dir, dim).select("node", "x"), ring_edges(spark, sf_dir, weighted), dim)


def trade_index(spark, sf_dir) -> DataFrame:
    """(src, dst, l_discount, l_tax) customer to supplier, a row for each line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + SUPPLIERS).alias("dst"), "l_discount", "l_tax")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    return lines.join(orders, "l_orderkey").select("src", "dst", "l_discount", "l_tax")


def trade(spark, sf_dir, mean=F.avg) -> Graph:
    """Customers and suppliers, an edge for each pair that trades, weighed by its lines, with edge features (means of its lines)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.array(F.col("c_acctbal") / 10000.0, F.col("c_nationkey") / 25.0, F.lit(1.0), F.lit(0.0)).alias("x"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + SUPPLIERS).alias("node"), F.array(F.col("s_acctbal") / 10000.0, F.col("s_nationkey") / 25.0, F.lit(1.0), F.lit(1.0)).alias("x"))
    edges = trade_index(spark, sf_dir).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"), F.array(mean(F.col("l_discount")), mean(F.col("l_tax"))).alias("e"))
    return Graph(c.unionByName(s), written(edges, "trade"), 4)  # the queries name the edges several times


def long(df: DataFrame, keys: list[str] = ("node",), h: str = "h") -> DataFrame:
    """(keys, dim, q): a row for each place, in millionths."""
    out = df.select(*keys, F.posexplode(h).alias("dim", "v"))
    return out.select(*[F.col(k).cast("long").alias(k) for k in keys], "dim", millionths(F.col("v")).alias("q"))


def millionths(v):
    return F.floor(v * 1e6 + 0.5).cast("long")
