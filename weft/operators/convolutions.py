"""Graph convolutions. Every layer takes a Graph and gives (node, h).

Layers built on message passing send from src to dst and ignore weights; layers built on ``adj_matmul``
are weighted and collect at src, but for GraphConvolution, which collects at dst. Weights are numpy
arrays of the driver in ``weights``, or names of initialisers, or functions like them; missing ones are drawn from
``glorot_uniform``, biases are zeros. Options that a layer's formula ignores are not taken. Dropout is drawn where
a layer is called with ``draw``, a seed; without one it is left out, as in inference.

Iterative layers (APPNP, ARMA, GatedGraph) run jobs when they are called: they lay the edges out once and write their state
every round, in the same buckets, so that a round moves partial sums of states once and no edges. Layers that gather along
edges count the edges of each node first, to find hubs.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.segments import keep_all, reduce_vectors, segment_softmax
from weft.functions.vectors import (
    SOFTMAX_EPSILON,
    activation,
    batch_norm,
    batch_statistics,
    concat,
    dense,
    dropout,
    gru,
    leaky_relu,
    literal,
    mlp,
    normalize,
    pad,
    polyval,
    prelu,
    total,
    vadd,
    vdot,
    vmul,
    vscale,
    zeros,
)
from weft.sources.balance import heavy
from weft.sources.graph import Graph
from weft.sources.layout import Layout, states
from weft.sources.written import written

from . import adjacency
from .message_passing import MessagePassing
from .params import Configured, glorot_uniform, initialised

#: Logits of attention are taken as they are while they can't overflow.
SAFE_LOGIT = 300.0


class Conv(Configured):
    """Base of the layers on adjacency products."""

    activation = None

    def __init__(self, weights: dict | None = None, activation=None, seed: int = 0):
        self.weights, self.activation, self.seed = dict(weights or {}), activation, seed

    def weight(self, name: str, rows: int, columns: int) -> np.ndarray:
        w = self.weights[name] = initialised(self.weights.get(name, glorot_uniform), rows, columns, self.seed + sum(map(ord, name)))
        if w.shape != (rows, columns):
            raise ValueError(f"{name} has the shape {w.shape}, not {(rows, columns)}")
        return w

    def bias(self, name: str, size: int) -> np.ndarray:
        w = self.weights[name] = np.ravel(initialised(self.weights.get(name, "zeros"), 1, size, self.seed + sum(map(ord, name))))
        return w

    @staticmethod
    def preprocess(edges: DataFrame, nodes: DataFrame) -> DataFrame:
        return edges


def _masked(h: Column, nodes: DataFrame) -> Column:
    return vscale(h, F.col("mask").cast("double")) if "mask" in nodes.columns else h


class SAGEConv(Conv):
    """h = (A x / max(row sum, 1)) W_rel + x W_root + b; optionally of length 1 and masked."""

    def __init__(self, out_channels: int, normalize: bool = False, bias: bool = True, weights=None, seed: int = 0):
        super().__init__(weights, None, seed)
        self.out_channels, self.normalize, self.use_bias = out_channels, normalize, bias

    def __call__(self, graph: Graph) -> DataFrame:
        w_rel, w_root = (self.weight(n, graph.dim, self.out_channels) for n in ("rel", "root"))
        b = self.bias("bias", self.out_channels) if self.use_bias else None
        side = graph.nodes.select(F.col("node").alias("dst"), "x")
        met = heavy(graph.edges, ["dst"]).join(graph.edges.select("src", "dst", "w"), side)
        sums = reduce_vectors(met.select(F.col("src").alias("node"), "w", vscale(F.col("x"), F.col("w")).alias("wx")), ["node"], "wx", graph.dim, "sum", "m", [F.sum("w").alias("degree")])
        rows = keep_all(graph.nodes, sums, ["node"], {"m": zeros(graph.dim), "degree": F.lit(0.0)})
        mean = F.transform("m", lambda v: v / F.greatest(F.col("degree"), F.lit(1.0)))
        h = vadd(dense(mean, w_rel), dense(F.col("x"), w_root, b))
        h = normalize(h) if self.normalize else h
        return rows.select("node", _masked(h, graph.nodes).alias("h"))


class AGNNConv(MessagePassing):
    """Attention by cosine: softmax over a target's edges of beta <n_dst, n_src>, weighing the sources."""

    def __init__(self, trainable: bool = True, aggregate="sum", activation=None, beta: float = 1.0):
        super().__init__(aggregate, activation)
        self.trainable, self.beta = trainable, float(beta) if trainable else 1.0

    def __call__(self, graph: Graph) -> DataFrame:
        graph = self.get_inputs(graph)
        nodes = graph.nodes.withColumn("n", normalize(F.col("x")))
        edges = self.gather(graph.with_features(nodes, graph.dim), ["x", "n"], {"source", "target"})
        logit = vdot(F.col("t_n"), F.col("s_n")) * F.lit(self.beta)
        rows = edges.select(F.col("dst").alias("node"), logit.alias("l"), F.col("s_x").alias("x"))
        if self.aggregate == "sum" and abs(self.beta) <= SAFE_LOGIT:
            # logits stay within beta: sums and maximum in one pass, the shift put in afterwards
            sums = reduce_vectors(rows.withColumn("v", vscale(F.col("x"), F.exp("l"))), ["node"], "v", graph.dim, "sum", "s", [F.sum(F.exp("l")).alias("z"), F.max("l").alias("top")])
            found = sums.select("node", vscale(F.col("s"), F.lit(1.0) / (F.col("z") + F.lit(SOFTMAX_EPSILON) * F.exp("top"))).alias("agg"))
        else:
            rows = segment_softmax(rows, ["node"], "l")
            found = reduce_vectors(rows.withColumn("v", vscale(F.col("x"), F.col("alpha"))), ["node"], "v", graph.dim, self.aggregate, "agg")
        out = keep_all(graph.nodes.select("node"), found, ["node"], {"agg": F.array_repeat(F.lit(float(self.fill())), graph.dim)})
        return out.select("node", activation(self.activation)(F.col("agg")).alias("h"))


class APPNPConv(Conv):
    """Z <- (1 - alpha) A Z + alpha H over some rounds, H = MLP(x). The adjacency is normalised by ``preprocess``."""

    def __init__(self, channels: int, alpha: float = 0.2, propagations: int = 1, mlp_hidden=None, mlp_activation="relu", dropout_rate: float = 0.0, activation=None, weights=None, seed: int = 0):
        super().__init__(weights, activation, seed)
        self.channels, self.alpha, self.propagations = channels, alpha, propagations
        self.mlp_hidden, self.mlp_activation, self.dropout_rate = list(mlp_hidden or []), mlp_activation, dropout_rate

    preprocess = staticmethod(adjacency.gcn_filter)

    def _mlp(self, dim: int, draw: int | None) -> list[dict]:
        widths = [dim, *self.mlp_hidden, self.channels]
        acts = [self.mlp_activation] * len(self.mlp_hidden) + [None]
        layers = [{"w": self.weight(f"mlp{k}", a, b), "b": self.bias(f"mlp{k}_bias", b), "act": act} for k, (a, b, act) in enumerate(zip(widths[:-1], widths[1:], acts, strict=True))]
        for k, layer in enumerate(layers[:-1]):  # before each hidden layer
            layer["drop"] = lambda x, k=k: dropout(x, self.dropout_rate, None if draw is None else draw + k)
        return layers

    def __call__(self, graph: Graph, draw: int | None = None) -> DataFrame:
        rows = graph.nodes.withColumn("h0", mlp(F.col("x"), self._mlp(graph.dim, draw)))
        keep = [*[c for c in ("mask",) if c in graph.nodes.columns], "h0"]
        rows = states(rows.select("node", *keep, F.col("h0").alias("z")), "appnp")
        edges = Layout(graph.edges)
        for _ in range(self.propagations):
            moved = edges.product(rows, "z", self.channels, "az", keep)
            z = F.zip_with("az", "h0", lambda a, h: a * F.lit(1 - self.alpha) + h * F.lit(self.alpha))
            rows = states(moved.withColumn("z", z).drop("az"), "appnp", aligned=True)
        return rows.select("node", activation(self.activation)(_masked(F.col("z"), graph.nodes)).alias("h"))


class ARMAConv(Conv):
    """Mean over stacks of X <- gcn_activation(A (X W1) + X0 W2 + b); all stacks travel in one product."""

    def __init__(self, channels: int, order: int = 1, iterations: int = 1, share_weights: bool = False, gcn_activation="relu", dropout_rate: float = 0.0, activation=None, use_bias: bool = True, weights=None, seed: int = 0):
        super().__init__(weights, activation, seed)
        self.channels, self.order, self.iterations, self.share_weights = channels, order, iterations, share_weights
        self.gcn_activation, self.dropout_rate, self.use_bias = gcn_activation, dropout_rate, use_bias

    preprocess = staticmethod(adjacency.normalized_adjacency)

    def __call__(self, graph: Graph, draw: int | None = None) -> DataFrame:
        c, stacks = self.channels, range(self.order)
        rows = graph.nodes.select("node", "x", *[m for m in ("mask",) if m in graph.nodes.columns])
        edges = Layout(graph.edges) if self.iterations > 1 else None
        x = {k: F.col("x") for k in stacks}
        for i in range(self.iterations):
            at = min(i, 1) if self.share_weights else i
            width = graph.dim if i == 0 else c
            parts = [dense(x[k], self.weight(f"w1_{k}_{at}", width, c)) for k in stacks]
            rows = rows.withColumn("__xw", concat(*parts)).drop("__y")
            keep = [m for m in rows.columns if m not in ("node", "__xw")]
            if edges:
                rows = edges.product(states(rows, "arma", aligned=i > 0), "__xw", c * self.order, "__ax", keep)
            else:
                rows = adjacency.adj_matmul(graph.edges, written(rows, "arma"), "__xw", c * self.order, out="__ax", keep=keep)
            y = []
            for k in stacks:
                skip = dense(F.col("x"), self.weight(f"w2_{k}_{at}", graph.dim, c))
                skip = dropout(skip, self.dropout_rate, None if draw is None else draw + i * self.order + k)
                bias = literal(self.bias(f"b_{k}_{at}", c)) if self.use_bias else None
                y.append(activation(self.gcn_activation)(vadd(F.slice("__ax", k * c + 1, c), skip if bias is None else vadd(skip, bias))))
            rows = rows.withColumn("__y", concat(*y)).drop("__ax")
            x = {k: F.slice("__y", k * c + 1, c) for k in stacks}
        mean = F.transform(reduce(vadd, x.values()), lambda v: v / F.lit(float(self.order)))
        return rows.select("node", activation(self.activation)(_masked(mean, graph.nodes)).alias("h"))


class CrystalConv(MessagePassing):
    """x + sum over edges of act(z W_s + b_s) * sigmoid(z W_f + b_f), z = [x_dst, x_src, e]."""

    def __init__(self, aggregate="sum", activation=None, edge_dim: int = 0, weights=None, seed: int = 0):
        super().__init__(aggregate, activation)
        self.edge_dim, self.params = edge_dim, Conv(weights, None, seed)

    def __call__(self, graph: Graph) -> DataFrame:
        width = 2 * graph.dim + self.edge_dim
        w = {n: self.params.weight(n, width, graph.dim) for n in ("s", "f")}
        b = {n: self.params.bias(f"{n}_bias", graph.dim) for n in ("s", "f")}

        d, edge = graph.dim, self.edge_dim
        # z W = x_dst W_dst + x_src W_src + e W_e: the first two are multiplied once a node and added on the edge
        part = lambda lo, hi: np.concatenate([w["s"][lo:hi], w["f"][lo:hi]], axis=1)
        both = np.concatenate([b["s"], b["f"]])
        g = self.get_inputs(graph)
        own = [c for c in g.edges.columns if c not in ("src", "dst")]
        edges = g.edges.filter("w <> 0").select("src", "dst", *[c for c in own if c == "e"])
        for key, columns, name, bias in (("dst", (0, d), "t", both), ("src", (d, 2 * d), "s", None)):
            side = g.nodes.select(F.col("node").alias(key), dense(F.col("x"), part(*columns), bias).alias(name))
            edges = heavy(g.edges, [key]).join(edges, side)
        z = vadd(F.col("t"), F.col("s"))
        z = vadd(z, dense(F.col("e"), part(2 * d, 2 * d + edge))) if edge else z
        edges = edges.select(F.col("dst").alias("node"), z.alias("z"))
        gate = activation("sigmoid")(F.slice("z", d + 1, d))
        edges = edges.select("node", vmul(activation(self.activation)(F.slice("z", 1, d)), gate).alias("m"))
        found = reduce_vectors(edges, ["node"], "m", d, self.aggregate, "agg")
        out = keep_all(g.nodes, found, ["node"], {"agg": F.array_repeat(F.lit(float(self.fill())), d)})
        return out.select("node", vadd(F.col("x"), F.col("agg")).alias("h"))


class DiffuseFeatures(Conv):
    """sum_f (P x)_if with P = polynomial of a_ij, element by element; absent edges count with the last coefficient.

    With s_j = sum_f x_jf and S = sum_j s_j this is theta_last * S + sum over edges of (P(w) - theta_last) s_dst,
    so that the sparse table is enough.
    """

    def __init__(self, num_diffusion_steps: int, thetas=None, filters: int = 1, seed: int = 0):
        super().__init__(None, None, seed)
        self.steps = num_diffusion_steps
        given = np.atleast_2d(np.asarray(thetas, float)) if thetas is not None else glorot_uniform(filters, num_diffusion_steps, seed)
        if given.shape[1] != num_diffusion_steps:
            raise ValueError(f"{given.shape[1]} coefficients for {num_diffusion_steps} steps")
        self.thetas = given

    preprocess = staticmethod(adjacency.normalized_adjacency)

    def __call__(self, graph: Graph) -> DataFrame:
        sums = graph.nodes.select("node", total(F.col("x")).alias("s"))
        whole = F.broadcast(sums.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("__all")))  # one row
        met = graph.edges.select("src", "dst", "w").join(sums.withColumnRenamed("node", "dst"), "dst")
        v = F.array(*[(polyval(t, F.col("w")) - F.lit(float(t[-1]))) * F.col("s") for t in self.thetas])
        found = reduce_vectors(met.select(F.col("src").alias("node"), v.alias("v")), ["node"], "v", len(self.thetas), "sum", "p")
        rows = keep_all(graph.nodes.select("node"), found, ["node"], {"p": zeros(len(self.thetas))}).crossJoin(whole)
        h = F.array(*[F.get("p", F.lit(c)) + F.lit(float(t[-1])) * F.col("__all") for c, t in enumerate(self.thetas)])
        return rows.select("node", h.alias("h"))


class DiffusionConv(Conv):
    """One diffusion filter of K + 1 coefficients for each channel, side by side, through the activation."""

    def __init__(self, channels: int, K: int = 6, activation="tanh", thetas=None, seed: int = 0):  # noqa: N803
        super().__init__(None, activation, seed)
        self.channels, self.K = channels, K
        self.filters = DiffuseFeatures(K + 1, thetas, channels, seed)

    preprocess = staticmethod(adjacency.normalized_adjacency)

    def __call__(self, graph: Graph) -> DataFrame:
        return self.filters(graph).select("node", activation(self.activation)(F.col("h")).alias("h"))


class GatedGraphConv(MessagePassing):
    """h = GRU(sum over edges of h_src W_l, h) for each layer l; one GRU for all; x is padded with zeros."""

    def __init__(self, channels: int, n_layers: int, activation=None, aggregate="sum", weights=None, seed: int = 0):
        super().__init__(aggregate, activation)
        self.channels, self.n_layers, self.params = channels, n_layers, Conv(weights, None, seed)

    def message_dim(self, graph: Graph) -> int:
        return self.channels

    def __call__(self, graph: Graph) -> DataFrame:
        c = self.channels
        cell = [self.params.weight("kernel", c, 3 * c), self.params.weight("recurrent", c, 3 * c), self.params.bias("gru_bias", 3 * c), self.params.bias("gru_recurrent_bias", 3 * c)]
        rows = self.get_inputs(graph).nodes.select("node", pad(F.col("x"), graph.dim, c).alias("x"))
        edges = Layout(graph.edges.filter("w <> 0"), "src", "dst")
        for layer in range(self.n_layers):
            sent = rows.select("node", "x", dense(F.col("x"), self.params.weight(f"w{layer}", c, c)).alias("m"))
            out = edges.product(states(sent, "gated", aligned=layer > 0), "m", c, "agg", ("x",), self.aggregate, False, self.fill())
            rows = out.select("node", gru(F.col("agg"), F.col("x"), *cell).alias("x"))
        return rows.select("node", activation(self.activation)(F.col("x")).alias("h"))


class GraphConvolution(Conv):
    """(A' x) W + b for each graph of a batch: collected at dst, not normalised."""

    def __init__(self, units: int, activation=None, use_bias: bool = True, final_layer=None, weights=None, seed: int = 0):
        if final_layer is not None:
            raise ValueError("final_layer is not supported")
        super().__init__(weights, activation, seed)
        self.units, self.use_bias = units, use_bias

    def __call__(self, graph: Graph) -> DataFrame:
        w = self.weight("kernel", graph.dim, self.units)
        b = self.bias("bias", self.units) if self.use_bias else None
        keys = [k for k in ("batch", "node") if k in graph.nodes.columns or k in graph.edges.columns]
        moved = adjacency.adj_matmul(graph.edges, graph.nodes, "x", graph.dim, transpose=True, out="ax")
        return moved.select(*keys, dense(F.col("ax"), w, b, self.activation).alias("h"))


class GeneralConv(MessagePassing):
    """Sum over edges of act(dropout(BN(x W + b))); nothing follows the sum.

    Called with ``draw``, BN takes the means and variances of the nodes at hand, as in training.
    """

    def __init__(self, channels: int = 256, batch_norm: bool = True, dropout: float = 0.0, aggregate="sum", activation="prelu", use_bias: bool = True, weights=None, seed: int = 0):
        super().__init__(aggregate, activation)
        self.channels, self.batch_norm, self.dropout, self.use_bias = channels, batch_norm, dropout, use_bias
        self.params = Conv(weights, None, seed)

    def message_dim(self, graph: Graph) -> int:
        return self.channels

    def __call__(self, graph: Graph, draw: int | None = None) -> DataFrame:
        c, p = self.channels, self.params
        h = dense(F.col("x"), p.weight("kernel", graph.dim, c), p.bias("bias", c) if self.use_bias else None)
        if self.batch_norm:
            one = np.ones(c)
            if draw is None:
                mean, variance = p.weights.get("mean", 0 * one), p.weights.get("variance", one)
            else:
                mean, variance = batch_statistics(graph.nodes.select(h.alias("h")), "h", c)
            h = batch_norm(h, mean, variance, p.weights.get("gamma", one), p.weights.get("beta", 0 * one))
        h = dropout(h, self.dropout, draw)
        h = prelu(h, p.bias("slope", c)) if self.activation == "prelu" else activation(self.activation)(h)
        rows = self.get_inputs(graph).nodes.select("node", h.alias("m"))
        out = self.propagate(graph.with_features(rows.withColumn("x", F.col("m")), c), lambda e: e.source("m"))
        return out.select("node", F.col("agg").alias("h"))


class GINConv(MessagePassing):
    """MLP((1 + epsilon) x + sum over edges of x_src); the bias option acts on the last layer only."""

    def __init__(self, channels: int, epsilon: float | None = None, mlp_hidden=None, mlp_activation="relu", mlp_batchnorm: bool = True, aggregate="sum", activation=None, use_bias: bool = True, weights=None, seed: int = 0):
        super().__init__(aggregate, activation)
        self.channels, self.epsilon = channels, 0.0 if epsilon is None else float(epsilon)
        self.mlp_hidden, self.mlp_activation, self.mlp_batchnorm, self.use_bias = list(mlp_hidden or []), mlp_activation, mlp_batchnorm, use_bias
        self.params = Conv(weights, None, seed)

    def __call__(self, graph: Graph) -> DataFrame:
        p, widths, layers = self.params, [graph.dim, *self.mlp_hidden, self.channels], []
        for k, (a, b) in enumerate(zip(widths[:-1], widths[1:], strict=True)):
            last = k == len(widths) - 2
            layer = {"w": p.weight(f"mlp{k}", a, b), "act": self.activation if last else self.mlp_activation}
            if not last or self.use_bias:
                layer["b"] = p.bias(f"mlp{k}_bias", b)
            if not last and self.mlp_batchnorm:
                one = np.ones(b)
                layer["bn"] = p.weights.get(f"bn{k}", (0 * one, one, one, 0 * one))
            layers.append(layer)
        out = self.propagate(self.get_inputs(graph))
        h = F.zip_with("x", "agg", lambda x, m: x * F.lit(1 + self.epsilon) + m)
        return out.select("node", mlp(h, layers).alias("h"))


class GraphAttention(Conv):
    """Attention of each node over its out-neighbours, several heads side by side or averaged.

    The additive mask of -1e10 (1 - a) is carried out as a rule: only edges whose weight is their row's
    largest count; where that is 1, by the softmax of the logits, otherwise evenly; a row without edges
    gets the mean of all nodes. ``saliency`` weighs the softmax by the edges' weights instead, and leaves
    rows without edges NaN; its delta is 1 and it counts no absent edges. With ``draw``, features and attention
    coefficients of edges fall out at their rates; the mean of a row without edges stays whole.
    """

    def __init__(self, units: int, attn_heads: int = 1, attn_heads_reduction: str = "concat", activation="relu", use_bias: bool = True, final_layer=None, saliency_map_support: bool = False, in_dropout_rate: float = 0.0, attn_dropout_rate: float = 0.0, weights=None, seed: int = 0):
        if attn_heads_reduction not in ("concat", "average"):
            raise ValueError("attn_heads_reduction is concat or average")
        if final_layer is not None:
            raise ValueError("final_layer is not supported")
        super().__init__(weights, activation, seed)
        self.units, self.attn_heads, self.attn_heads_reduction = units, attn_heads, attn_heads_reduction
        self.use_bias, self.saliency = use_bias, saliency_map_support
        self.in_dropout_rate, self.attn_dropout_rate = in_dropout_rate, attn_dropout_rate

    def __call__(self, graph: Graph, draw: int | None = None) -> DataFrame:
        c, heads = self.units, range(self.attn_heads)
        parts = [dense(F.col("x"), self.weight(f"kernel{k}", graph.dim, c)) for k in heads]
        rows = graph.nodes.select("node", concat(*parts).alias("f"))
        own = lambda k: F.slice("f", k * c + 1, c)
        score = lambda name: F.array(*[F.get(dense(own(k), self.weight(f"{name}{k}", c, 1)), F.lit(0)) for k in heads])
        rows = rows.select("node", "f", score("self").alias("a"), score("neighbour").alias("b"))
        rows = rows.withColumn("f", dropout(F.col("f"), self.in_dropout_rate, draw))  # scores see whole features
        edges = graph.edges.filter("w <> 0").select("src", "dst", "w")
        if not self.saliency:
            top = edges.groupBy("src").agg(F.max("w").alias("top"), F.min("w").alias("least"))
            edges = edges.join(top, "src").filter(F.col("w") == F.col("top"))
            edges = edges.withColumn("top", F.when(F.col("least") < 0, F.raise_error(F.lit("attention needs weights of 0 or more"))).otherwise(F.col("top")))
        met = heavy(graph.edges, ["dst"]).join(edges, rows.select(F.col("node").alias("dst"), "f", "b"))
        met = heavy(graph.edges, ["src"]).join(met, rows.select(F.col("node").alias("src"), "a"))
        logit = F.zip_with("a", "b", lambda x, y: leaky_relu(x + y))
        if not self.saliency:
            logit = F.when(F.col("top") == 1, logit).otherwise(F.array_repeat(F.lit(0.0), self.attn_heads))
        met = met.withColumn("l", logit)
        peak = reduce_vectors(met, ["src"], "l", self.attn_heads, "max", "peak")
        met = met.join(peak, "src")
        e = F.zip_with("l", "peak", lambda x, m: F.exp(x - m))
        met = met.withColumn("e", vscale(e, F.col("w")) if self.saliency else e)
        met = met.withColumn("__edge", F.xxhash64("src", "dst"))
        falls = dropout(F.col("e"), self.attn_dropout_rate, None if draw is None else draw + 1, "__edge")
        met = met.withColumn("u", falls)  # the sums that coefficients are divided by stay whole
        sent = concat(*[vscale(own(k), F.get("u", F.lit(k))) for k in heads], F.col("e"))
        wide = self.attn_heads * (c + 1)
        sums = reduce_vectors(met.select(F.col("src").alias("node"), sent.alias("v")), ["node"], "v", wide, "sum", "s")
        out = graph.nodes.select("node").join(sums, "node", "left")
        if self.saliency:
            absent = F.array_repeat(F.lit(float("nan")), c * self.attn_heads)
        else:
            mean = rows.agg(F.array(*[F.avg(F.get("f", F.lit(i))) for i in range(c * self.attn_heads)]).alias("mean"))
            out, absent = out.crossJoin(F.broadcast(mean)), F.col("mean")  # one row
        share = lambda k: vscale(F.slice("s", k * c + 1, c), F.lit(1.0) / F.get("s", F.lit(self.attn_heads * c + k)))
        found = concat(*[share(k) for k in heads])
        h = F.when(F.col("s").isNull(), absent).otherwise(found)
        if self.use_bias:
            h = vadd(h, concat(*[F.array(*map(F.lit, self.bias(f"bias{k}", c).tolist())) for k in heads]))
        if self.attn_heads_reduction == "average":
            # h stands in a column first, so that each head is sliced from a finished array
            out = out.withColumn("h", h)
            h = F.transform(reduce(vadd, [F.slice("h", k * c + 1, c) for k in heads]), lambda v: v / F.lit(float(self.attn_heads)))
        return out.select("node", activation(self.activation)(h).alias("h"))


def ppnp_propagation(edges: DataFrame, nodes: DataFrame, x: str, dim: int) -> DataFrame:
    """The propagation matrix times the predictions: adjacency first, features second."""
    return adjacency.adj_matmul(edges, nodes, x, dim)


def random_features(dim: int) -> int:
    return int(dim * math.log(dim))
