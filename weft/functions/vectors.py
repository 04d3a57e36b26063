"""Vector algebra on ARRAY<DOUBLE> columns, activations, and the dense layer."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Small constants of the layers (fixed values).
SOFTMAX_EPSILON = 1e-9
NORM_EPSILON = 1e-7
BATCH_NORM_EPSILON = 1e-3
LOWEST = -3.4028234663852886e38
#: From so many weights on, a dense layer goes through Arrow to numpy instead of array functions.
NUMPY_WEIGHTS = 512


def literal(values) -> Column:
    """A constant vector, or a constant array of vectors."""
    values = np.asarray(values, float)
    if values.ndim == 1:
        return F.array(*[F.lit(float(v)) for v in values])
    return F.array(*[literal(row) for row in values])


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def vadd(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vsub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vmul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def vscale(a: Column, s: Column) -> Column:
    return F.transform(a, lambda x: x * s)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def vdot(a: Column, b: Column) -> Column:
    return total(vmul(a, b))


def norm(a: Column, p: float = 2) -> Column:
    if p == 2:
        return F.sqrt(total(F.transform(a, lambda x: x * x)))
    if p == 1:
        return total(F.transform(a, F.abs))
    return F.pow(total(F.transform(a, lambda x: F.pow(F.abs(x), F.lit(float(p))))), F.lit(1.0 / p))


def once(a: Column, f: Callable[[Column], Column]) -> Column:
    """f(a) with ``a`` bound to a variable: it is computed once, and may come from a vectorised function."""
    return F.get(F.transform(F.array(a), f), F.lit(0))


def normalize(a: Column, p: float = 2) -> Column:
    """a / max(|a|_p, 1e-7); a zero vector stays zero."""
    return once(F.array(a, F.array(F.greatest(norm(a, p), F.lit(NORM_EPSILON)))), lambda v: F.transform(v[0], lambda x: x / v[1][0]))


def concat(*vectors: Column) -> Column:
    return F.concat(*vectors)


def pad(a: Column, width: int, to: int) -> Column:
    if to < width:
        raise ValueError(f"can't pad {width} columns to {to}")
    return a if to == width else F.concat(a, zeros(to - width))


def softmax(a: Column) -> Column:
    shifted = once(a, lambda v: once(F.array(v, F.array(F.array_max(v))), lambda u: F.transform(u[0], lambda x: F.exp(x - u[1][0]))))
    return once(shifted, lambda v: once(F.array(v, F.array(total(v))), lambda u: F.transform(u[0], lambda x: x / u[1][0])))


def log_softmax(a: Column) -> Column:
    def shift(v):
        m = F.array_max(v)
        return F.array(v, F.array(m + F.ln(total(F.transform(v, lambda y: F.exp(y - m))))))

    return once(a, lambda v: once(shift(v), lambda u: F.transform(u[0], lambda x: x - u[1][0])))


def argmax(a: Column) -> Column:
    """Place of the first largest element, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def polyval(coefficients, x: Column) -> Column:
    """Horner's rule, highest power first, at one value; map it over an array with F.transform."""
    out = F.lit(0.0)
    for c in coefficients:
        out = out * x + F.lit(float(c))
    return out


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def elementwise(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda a: F.transform(a, f)


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x > 0, x).otherwise(x * F.lit(slope))


def sigmoid_value(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


ACTIVATIONS: dict[str, Callable[[Column], Column]] = {
    "linear": lambda a: a,
    "relu": elementwise(lambda x: F.greatest(x, F.lit(0.0))),
    "tanh": elementwise(F.tanh),
    "sigmoid": elementwise(sigmoid_value),
    "leaky_relu": elementwise(leaky_relu),
    "exp": elementwise(F.exp),
    "softmax": softmax,
    "log_softmax": log_softmax,
}


def activation(a) -> Callable[[Column], Column]:
    """An activation by name, None for none, or any function from array column to array column."""
    if a is None:
        return ACTIVATIONS["linear"]
    if callable(a):
        return a
    if a not in ACTIVATIONS:
        raise ValueError(f"unknown activation {a!r}")
    return ACTIVATIONS[a]


def prelu(a: Column, slope) -> Column:
    """max(x, 0) + slope * min(x, 0), with a slope for each place."""
    return F.zip_with(a, literal(slope), lambda x, s: F.greatest(x, F.lit(0.0)) + s * F.least(x, F.lit(0.0)))


def batch_norm(a: Column, mean, variance, gamma, beta, epsilon: float = BATCH_NORM_EPSILON) -> Column:
    """Inference: (x - mean) / sqrt(variance + epsilon) * gamma + beta, folded into one scale and shift."""
    scale = np.asarray(gamma, float) / np.sqrt(np.asarray(variance, float) + epsilon)
    shift = np.asarray(beta, float) - np.asarray(mean, float) * scale
    return vadd(vmul(a, literal(scale)), literal(shift))


def dropout(a: Column, rate: float, seed: int | None = None, key: str = "node") -> Column:
    """Identity at inference; with a seed, places fall out at the rate and the others are scaled up.

    What falls out depends on the seed, the row's ``key`` and the place only, so that a task that runs again agrees.
    """
    if seed is None or rate <= 0:
        return a
    stays = lambda i: F.pmod(F.xxhash64(F.col(key), i, F.lit(seed)), F.lit(1 << 20)) >= int(rate * (1 << 20))
    return F.transform(a, lambda x, i: F.when(stays(i), x / (1 - rate)).otherwise(0.0))


def batch_statistics(df: DataFrame, x: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of the places of a column over all rows, as batch normalisation takes them in training: one row."""
    places = [F.get(x, F.lit(i)) for i in range(dim)]
    row = df.agg(F.array(*[F.avg(p) for p in places]).alias("m"), F.array(*[F.var_pop(p) for p in places]).alias("v")).first()
    return np.array(row["m"], float), np.array(row["v"], float)


def dense(x: Column, w, b=None, act=None) -> Column:
    """act(x W + b) for each row. W is a numpy matrix (inputs x outputs) of the driver, inlined or sent along."""
    w = np.asarray(w, float)
    if w.size >= NUMPY_WEIGHTS:
        out = _dense_numpy(w, None if b is None else np.asarray(b, float))(x)
    else:
        out = F.transform(literal(w.T), lambda row: vdot(x, row))
        out = out if b is None else vadd(out, literal(b))
    return activation(act)(out)


def _dense_numpy(w: np.ndarray, b: np.ndarray | None):
    @F.pandas_udf("array<double>")
    def product(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        y = np.stack(x.to_numpy()) @ w
        return pd.Series(list(y if b is None else y + b))

    return product


def mlp(x: Column, layers: list[dict]) -> Column:
    """Dense layers one after the other: dicts with w and, where wanted, b, act, bn (mean, variance, gamma, beta), and
    drop, a function that comes before."""
    for layer in layers:
        x = layer["drop"](x) if "drop" in layer else x
        x = dense(x, layer["w"], layer.get("b"), layer.get("act"))
        if "bn" in layer:
            x = batch_norm(x, *layer["bn"])
    return x


def gru(m: Column, h: Column, kernel, recurrent, bias, recurrent_bias) -> Column:
    """A GRU cell that resets after the recurrent product; gates in the order update, reset, candidate."""
    units = np.asarray(recurrent).shape[0]
    a, r = dense(m, kernel, bias), dense(h, recurrent, recurrent_bias)
    part = lambda c, k: F.slice(c, k * units + 1, units)
    z = ACTIVATIONS["sigmoid"](vadd(part(a, 0), part(r, 0)))
    reset = ACTIVATIONS["sigmoid"](vadd(part(a, 1), part(r, 1)))
    candidate = ACTIVATIONS["tanh"](vadd(part(a, 2), vmul(reset, part(r, 2))))
    return vadd(vmul(z, h), F.zip_with(z, candidate, lambda s, c: (F.lit(1.0) - s) * c))
