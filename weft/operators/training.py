"""Training by reverse mode over joins.

A model is a list of steps over named node vectors. ``Local`` steps work row by row: consecutive ones are one pass over the
nodes' table, matrices in numpy an Arrow batch at a time. ``Edges`` steps sum vectors along edges that were laid out once. Forward, every
vector is kept as a column of the nodes' table, which is written in buckets of the node at each ``Edges`` step. Backward,
the steps run the other way: a pass gives each vector's gradient as a column, and the gradient of a sum along edges is the
sum along the edges turned round. A task adds up the parameters' gradients of its rows and emits them as one row; these
are merged as partial states. Parameters are arrays of the driver, as in all layers; nodes and edges never are.

Defined results: a node with a null label, or outside the mask, takes no part in the loss but passes gradients on; without any labelled
node the loss is null and gradients are zeros.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.mergeable import SegmentAggregate, aggregate, segment_sum
from weft.functions.vectors import vadd
from weft.sources.graph import Graph
from weft.sources.layout import Layout, states

from .params import glorot_uniform, table

#: Adam (fixed values).
BETA_1, BETA_2, EPSILON = 0.9, 0.999, 1e-7
_VECTOR = T.ArrayType(T.DoubleType())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


#: {name: (function, derivative from the function's value)}
CURVES: dict[str | None, tuple[Callable, Callable]] = {
    None: (lambda x: x, lambda y: np.ones_like(y)),
    "relu": (lambda x: np.maximum(x, 0), lambda y: (y > 0).astype(float)),
    "tanh": (np.tanh, lambda y: 1 - y * y),
    "sigmoid": (_sigmoid, lambda y: y * (1 - y)),
}


class Step:
    """``reads`` are vectors that exist, ``writes`` is the one that the step makes."""

    reads: list[str]
    writes: str

    def shapes(self, widths: dict[str, int]) -> dict[str, tuple[int, ...]]:
        """The shapes of its parameters; puts the width of what it writes into ``widths``."""
        raise NotImplementedError


class Local(Step):
    def forward(self, p: dict, x: list[np.ndarray], node: np.ndarray, draw: int | None) -> np.ndarray:
        raise NotImplementedError

    def backward(self, p: dict, x: list[np.ndarray], y: np.ndarray, g: np.ndarray, node: np.ndarray, draw: int | None) -> tuple[list[np.ndarray], dict[str, np.ndarray]]:
        """Gradients of what it reads, and of its parameters summed over the rows, from the gradient of what it writes."""
        raise NotImplementedError


class Dense(Local):
    """act(x W + b); parameters ``name``/w and ``name``/b."""

    def __init__(self, name: str, reads: str, writes: str, width: int, act: str | None = None, bias: bool = True):
        self.name, self.reads, self.writes, self.width, self.act, self.bias = name, [reads], writes, width, act, bias

    def shapes(self, widths):
        widths[self.writes] = self.width
        return {f"{self.name}/w": (widths[self.reads[0]], self.width)} | ({f"{self.name}/b": (self.width,)} if self.bias else {})

    def forward(self, p, x, node, draw):
        y = x[0] @ p[f"{self.name}/w"]
        return CURVES[self.act][0](y + p[f"{self.name}/b"] if self.bias else y)

    def backward(self, p, x, y, g, node, draw):
        g = g * CURVES[self.act][1](y)
        return [g @ p[f"{self.name}/w"].T], {f"{self.name}/w": x[0].T @ g} | ({f"{self.name}/b": g.sum(axis=0)} if self.bias else {})


class Pad(Local):
    """Zeros behind a vector."""

    def __init__(self, reads: str, writes: str, width: int):
        self.reads, self.writes, self.width = [reads], writes, width

    def shapes(self, widths):
        widths[self.writes] = self.width
        return {}

    def forward(self, p, x, node, draw):
        return np.pad(x[0], ((0, 0), (0, self.width - x[0].shape[1])))

    def backward(self, p, x, y, g, node, draw):
        return [g[:, : x[0].shape[1]]], {}


class Drop(Local):
    """Places fall out at a rate, by a hash of the draw, the node and the place; nothing happens without a draw."""

    def __init__(self, reads: str, writes: str, rate: float, seed: int = 0):
        self.reads, self.writes, self.rate, self.seed = [reads], writes, rate, seed

    def shapes(self, widths):
        widths[self.writes] = widths[self.reads[0]]
        return {}

    def _stays(self, node, width, draw):
        if draw is None or not self.rate:
            return 1.0
        h = node.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(width, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(draw * 1000 + self.seed)
        for k in (30, 27, 31):
            h = (h ^ (h >> np.uint64(k))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h >> np.uint64(11)) / 2.0**53 >= self.rate) / (1 - self.rate)

    def forward(self, p, x, node, draw):
        return x[0] * self._stays(node, x[0].shape[1], draw)

    def backward(self, p, x, y, g, node, draw):
        return [g * self._stays(node, g.shape[1], draw)], {}


class Gru(Local):
    """A GRU cell that resets after the recurrent product, from a message and a state; gates in the order update, reset, candidate."""

    def __init__(self, name: str, message: str, state: str, writes: str):
        self.name, self.reads, self.writes = name, [message, state], writes

    def shapes(self, widths):
        c = widths[self.writes] = widths[self.reads[1]]
        return {f"{self.name}/kernel": (widths[self.reads[0]], 3 * c), f"{self.name}/recurrent": (c, 3 * c), f"{self.name}/bias": (3 * c,), f"{self.name}/recurrent_bias": (3 * c,)}

    def _parts(self, p, x):
        m, h = x
        c = h.shape[1]
        a = m @ p[f"{self.name}/kernel"] + p[f"{self.name}/bias"]
        r = h @ p[f"{self.name}/recurrent"] + p[f"{self.name}/recurrent_bias"]
        z, reset = _sigmoid(a[:, :c] + r[:, :c]), _sigmoid(a[:, c : 2 * c] + r[:, c : 2 * c])
        return z, reset, r[:, 2 * c :], np.tanh(a[:, 2 * c :] + reset * r[:, 2 * c :])

    def forward(self, p, x, node, draw):
        z, _, _, new = self._parts(p, x)
        return z * x[1] + (1 - z) * new

    def backward(self, p, x, y, g, node, draw):
        m, h = x
        z, reset, back, new = self._parts(p, x)
        d_new = g * (1 - z) * (1 - new * new)
        d_z = g * (h - new) * z * (1 - z)
        d_reset = d_new * back * reset * (1 - reset)
        d_a = np.concatenate([d_z, d_reset, d_new], axis=1)
        d_r = np.concatenate([d_z, d_reset, d_new * reset], axis=1)
        grads = {f"{self.name}/kernel": m.T @ d_a, f"{self.name}/recurrent": h.T @ d_r, f"{self.name}/bias": d_a.sum(axis=0), f"{self.name}/recurrent_bias": d_r.sum(axis=0)}
        return [d_a @ p[f"{self.name}/kernel"].T, d_r @ p[f"{self.name}/recurrent"].T + g * z], grads


class Edges(Step):
    """Sums along edges: at ``to``, of w times the vectors at ``of`` (or of the vectors, where weights don't count)."""

    def __init__(self, reads: str, writes: str, of: str = "src", to: str = "dst", weigh: bool = False):
        self.reads, self.writes, self.of, self.to, self.weigh = [reads], writes, of, to, weigh

    def shapes(self, widths):
        widths[self.writes] = widths[self.reads[0]]
        return {}


def gated(name: str, reads: str, writes: str, layers: int) -> list[Step]:
    """A gated graph convolution as steps; what it reads is as wide as its channels."""
    steps, h = [], reads
    for k in range(layers):
        out = writes if k == layers - 1 else f"{name}{k}"
        steps += [_Square(f"{name}/{k}", h, f"{name}m{k}"), Edges(f"{name}m{k}", f"{name}a{k}"), Gru(f"{name}/gru", f"{name}a{k}", h, out)]
        h = out
    return steps


class _Square(Dense):
    """A dense layer as wide as what it reads, without bias."""

    def __init__(self, name, reads, writes):
        super().__init__(name, reads, writes, 0, None, False)

    def shapes(self, widths):
        self.width = widths[self.reads[0]]
        return super().shapes(widths)


class _Sum(SegmentAggregate):
    def start(self, data, index, count):
        return segment_sum(data, index, count)


@dataclass
class Adam:
    """Steps of Adam; ``m``, ``v`` and ``steps`` are its state, as a table by ``state``."""

    rate: float = 1e-3
    steps: int = 0
    m: dict = field(default_factory=dict)
    v: dict = field(default_factory=dict)

    def update(self, params: dict, grads: dict) -> None:
        self.steps += 1
        for name, g in grads.items():
            self.m[name] = BETA_1 * self.m.get(name, 0 * g) + (1 - BETA_1) * g
            self.v[name] = BETA_2 * self.v.get(name, 0 * g) + (1 - BETA_2) * g * g
            m, v = self.m[name] / (1 - BETA_1**self.steps), self.v[name] / (1 - BETA_2**self.steps)
            params[name] = params[name] - self.rate * m / (np.sqrt(v) + EPSILON)

    def state(self, spark: SparkSession, params: dict) -> DataFrame:
        """(layer, name, i, j, value) of parameters and both moments."""
        rows = [("adam", "steps", 0, None, float(self.steps))]
        for kind, own in (("params", params), ("m", self.m), ("v", self.v)):
            for name, w in sorted(own.items()):
                rows += [(kind, name, i[0], i[1] if w.ndim == 2 else None, float(x)) for i, x in np.ndenumerate(w)]
        return table(spark, rows)


# Regularisers: (penalty, gradient) of a parameter. Constraints: projections after a step.


def l1(k: float):
    return lambda w: (k * np.abs(w).sum(), k * np.sign(w))


def l2(k: float):
    return lambda w: (k * (w * w).sum(), 2 * k * w)


def max_norm(limit: float):
    """Columns no longer than ``limit``."""
    return lambda w: w * np.minimum(1, limit / np.maximum(np.sqrt((w * w).sum(axis=0, keepdims=True)), EPSILON))


def unit_norm(w: np.ndarray) -> np.ndarray:
    return w / np.maximum(np.sqrt((w * w).sum(axis=0, keepdims=True)), EPSILON)


def non_negative(w: np.ndarray) -> np.ndarray:
    return np.maximum(w, 0)


class Model:
    """Steps from ``x`` to logits, trained by softmax cross-entropy.

    ``regularisers`` and ``constraints`` are {parameter: function}; parameters not given start from ``glorot_uniform``, biases from zeros.
    """

    def __init__(self, steps: list[Step], dim: int, logits: str, params: dict | None = None, regularisers: dict | None = None, constraints: dict | None = None, seed: int = 0):
        self.steps, self.logits = steps, logits
        self.widths, self.shapes = {"x": dim}, {}
        for step in steps:
            if missing := [r for r in step.reads if r not in self.widths]:
                raise ValueError(f"{missing} are read before they are written")
            self.shapes |= step.shapes(self.widths)
        start = lambda i, s: glorot_uniform(*s, seed + i) if len(s) == 2 else np.zeros(s)
        self.params = {n: np.asarray((params or {}).get(n, start(i, s)), float) for i, (n, s) in enumerate(self.shapes.items())}
        if odd := [n for n, s in self.shapes.items() if self.params[n].shape != s]:
            raise ValueError(f"parameters {odd} have other shapes than {[self.shapes[n] for n in odd]}")
        self.regularisers, self.constraints = dict(regularisers or {}), dict(constraints or {})

    # forward

    def layouts(self, graph: Graph) -> dict:
        """The edges, laid out for each direction that the steps need; made once, for all steps of training."""
        edges, out = graph.edges.filter("w <> 0"), {}
        for s in self.steps:
            if isinstance(s, Edges):
                for of, to in ((s.of, s.to), (s.to, s.of)):
                    if (of, to) not in out:
                        out[of, to] = Layout(edges, of, to)
        return out

    def _segments(self) -> list[list[Step]]:
        """Runs of local steps, and edge steps by themselves."""
        out: list[list[Step]] = [[]]
        for s in self.steps:
            if isinstance(s, Edges):
                out += [[s], []]
            else:
                out[-1].append(s)
        return out

    def forward(self, nodes: DataFrame, layouts: dict, draw: int | None = None) -> DataFrame:
        """``nodes`` with every vector as a column, written."""
        rows, began = nodes, False
        for segment in self._segments():
            if segment and isinstance(segment[0], Edges):
                s = segment[0]
                rows = states(rows, "forward", aligned=began)
                began = True
                keep = [c for c in rows.columns if c != "node"]
                rows = layouts[s.of, s.to].product(rows, s.reads[0], self.widths[s.writes], s.writes, keep, weigh=s.weigh)
            elif segment:
                rows = self._run(rows, segment, draw)
        return states(rows, "forward", aligned=began)

    def _run(self, rows: DataFrame, segment: list[Local], draw: int | None) -> DataFrame:
        p, names = self.params, rows.columns
        schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema.fields], *[T.StructField(s.writes, _VECTOR) for s in segment]])

        def run(batches):
            for batch in batches:
                if len(batch):
                    node, x = _columns(batch, names)
                    for s in segment:
                        x[s.writes] = s.forward(p, [x[r] for r in s.reads], node, draw)
                    yield pa.RecordBatch.from_arrays([*batch.columns, *[_array(x[s.writes]) for s in segment]], names=[*names, *[s.writes for s in segment]])

        return rows.mapInArrow(run, schema)

    # backward

    def loss(self, rows: DataFrame) -> tuple[float | None, int]:
        """Mean cross-entropy of the labelled rows, and their number."""
        top = F.array_max(self.logits)
        log_sum = top + F.ln(F.aggregate(self.logits, F.lit(0.0), lambda a, v: a + F.exp(v - top)))
        own = F.when(_counts(rows), log_sum - F.get(self.logits, F.col("label").cast("int")))
        row = rows.agg(F.avg(own).alias("loss"), F.count(own).alias("n")).first()
        return row["loss"], row["n"]

    def gradients(self, rows: DataFrame, layouts: dict, n: int, draw: int | None = None) -> dict[str, np.ndarray]:
        """Gradients of the mean loss by parameter, from what ``forward`` gave."""
        start = rows.withColumn("__counts", _counts(rows))
        grads = {name: np.zeros(s) for name, s in self.shapes.items()}
        last, frame = self._segments()[::-1], start
        for k, segment in enumerate(last):
            if segment and isinstance(segment[0], Edges):
                s = segment[0]
                back = layouts[s.to, s.of].product(frame, f"d_{s.writes}", self.widths[s.writes], "__back", [c for c in frame.columns if c != "node"], weigh=s.weigh)
                d = f"d_{s.reads[0]}"
                added = F.coalesce(vadd(F.col(d), F.col("__back")), F.col("__back")) if d in frame.columns else F.col("__back")
                frame = back.withColumn(d, added).drop("__back", s.writes, f"d_{s.writes}")
                continue
            if not segment and k:
                continue
            frame = self._back(frame, segment, n, draw, first=k == 0)
            frame = states(frame, "backward", aligned=True)
            parts = frame.filter("node is null").select(F.lit(0).alias("one"), "__g")
            total = aggregate(parts, ["one"], "__g", _Sum()).first()
            if total:
                self._add(grads, np.array(total["h"]))
            frame = frame.filter("node is not null").drop("__g")
        return grads

    def _add(self, grads: dict, flat: np.ndarray) -> None:
        at = 0
        for name, shape in self.shapes.items():
            size = int(np.prod(shape))
            grads[name] = grads[name] + flat[at : at + size].reshape(shape)
            at += size

    def _back(self, rows: DataFrame, segment: list[Local], n: int, draw: int | None, first: bool) -> DataFrame:
        """Gradient columns of what a run of steps reads, and a row of the parameters' gradients from each task."""
        p, names, logits, shapes = self.params, rows.columns, self.logits, self.shapes
        made = {s.writes for s in segment}
        read = sorted({r for s in segment for r in s.reads} - made | ({logits} - made if first else set()))
        gone = made | {f"d_{m}" for m in made}
        kept = [f for f in rows.schema.fields if f.name not in gone and f.name not in {f"d_{r}" for r in read}]
        schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in kept], *[T.StructField(f"d_{r}", _VECTOR) for r in read], T.StructField("__g", _VECTOR)])

        def run(batches):
            total, some = {name: np.zeros(s) for name, s in shapes.items()}, False
            for batch in batches:
                if not len(batch):
                    continue
                some = True
                node, x = _columns(batch, names)
                d = {c[2:]: x[c] for c in names if c.startswith("d_") and c in x}
                if first:
                    d[logits] = d.get(logits, 0) + _loss_gradient(x[logits], batch.column(names.index("label")), batch.column(names.index("__counts")), n)
                for s in reversed(segment):
                    g = d.pop(s.writes, None)
                    if g is None:
                        g = np.zeros_like(x[s.writes])
                    inputs, own = s.backward(p, [x[r] for r in s.reads], x[s.writes], g, node, draw)
                    for r, v in zip(s.reads, inputs, strict=True):
                        d[r] = d[r] + v if r in d else v
                    for name, v in own.items():
                        total[name] += v
                columns = [batch.column(names.index(f.name)) for f in kept] + [_array(d[r]) for r in read] + [pa.nulls(len(batch), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            if some:
                flat = np.concatenate([total[name].ravel() for name in shapes]) if shapes else np.zeros(0)
                columns = [pa.nulls(1, batch.column(names.index(f.name)).type) for f in kept] + [pa.nulls(1, pa.list_(pa.float64())) for _ in read] + [_array(flat[None])]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return rows.mapInArrow(run, schema)

    def step(self, nodes: DataFrame, layouts: dict, adam: Adam, draw: int | None = None) -> float | None:
        """One step of training on the whole graph; the loss before it, with penalties."""
        rows = self.forward(nodes, layouts, draw)
        loss, n = self.loss(rows)
        grads = self.gradients(rows, layouts, max(n, 1), draw)
        for name, f in self.regularisers.items():
            penalty, slope = f(self.params[name])
            loss, grads[name] = (loss or 0.0) + penalty, grads[name] + slope
        adam.update(self.params, grads)
        for name, f in self.constraints.items():
            self.params[name] = f(self.params[name])
        return loss

    def fit(self, graph: Graph, steps: int, adam: Adam | None = None, draw: int | None = None) -> list[float]:
        """The losses of some steps. The graph's nodes have a label, and may have a mask of those that count."""
        adam = adam or Adam()
        layouts = self.layouts(graph)
        nodes = states(graph.nodes.select("node", "label", *[c for c in ("mask",) if c in graph.nodes.columns], "x"), "nodes")
        return [self.step(nodes, layouts, adam, None if draw is None else draw + k) for k in range(steps)]

    def predict(self, graph: Graph) -> DataFrame:
        """(node, label, h): the logits, as outside of training."""
        columns = [c for c in ("label", "mask") if c in graph.nodes.columns]
        rows = self.forward(states(graph.nodes.select("node", *columns, "x"), "nodes"), self.layouts(graph))
        return rows.select("node", *columns, F.col(self.logits).alias("h"))


def _counts(rows: DataFrame):
    labelled = F.col("label").isNotNull()
    return labelled & F.coalesce(F.col("mask").cast("boolean"), F.lit(False)) if "mask" in rows.columns else labelled


def _columns(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Node numbers, and the vector columns as matrices; a null vector is zeros."""
    x = {}
    for name, c in zip(names, batch.columns, strict=True):
        if pa.types.is_list(c.type) and c.null_count < len(c):
            if c.null_count:
                width = len(c.drop_null()[0])
                m = np.zeros((len(c), width))
                m[~np.asarray(c.is_null())] = c.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                x[name] = m
            else:
                x[name] = c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(c), -1)
    return batch.column(names.index("node")).to_numpy(zero_copy_only=False), x


def _array(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, float)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32)[: len(x) + 1]), pa.array(x.ravel()))


def _loss_gradient(logits: np.ndarray, label: pa.Array, counts: pa.Array, n: int) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    g = e / e.sum(axis=1, keepdims=True)
    own = np.flatnonzero(np.asarray(counts))
    g[own, label.fill_null(0).to_numpy(zero_copy_only=False)[own]] -= 1
    g[~np.asarray(counts)] = 0
    return g / n
