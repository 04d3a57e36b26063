"""Weights of layers: seeded initialisers, simple exact ones, and a table form."""

from __future__ import annotations

import inspect

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def glorot_uniform(rows: int, columns: int, seed: int = 0) -> np.ndarray:
    limit = np.sqrt(6.0 / (rows + columns))
    return np.random.default_rng(seed).uniform(-limit, limit, (rows, columns))


def orthogonal_block(dim: int, seed: int | None = None) -> np.ndarray:
    """The transpose of Q of a random normal matrix's QR decomposition."""
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0].T


def orthogonal(rows: int, columns: int, seed: int | None = 0) -> np.ndarray:
    """Orthogonal blocks on top of each other, the last one cut to fit."""
    blocks = [orthogonal_block(columns, None if seed is None else seed + k) for k in range(-(-rows // columns))]
    return np.concatenate(blocks)[:rows] if blocks else np.zeros((0, columns))


def dyadic(rows: int, columns: int, seed: int = 0) -> np.ndarray:
    """(((31 i + 17 j + 7 seed) mod 13) - 6) / 8 for output i and input j: exact in any engine."""
    i, j = np.arange(columns)[None], np.arange(rows)[:, None]
    return (((i * 31 + j * 17 + seed * 7) % 13) - 6) / 8.0


def dyadic_vector(size: int, seed: int = 0) -> np.ndarray:
    return dyadic(1, size, seed)[0]


INITIALISERS = {
    "glorot_uniform": glorot_uniform,
    "orthogonal": orthogonal,
    "zeros": lambda rows, columns, seed=0: np.zeros((rows, columns)),
    "ones": lambda rows, columns, seed=0: np.ones((rows, columns)),
    "dyadic": dyadic,
}


def initialised(given, rows: int, columns: int, seed: int) -> np.ndarray:
    """A matrix from what was given for it: an array, the name of an initialiser, or a function like one."""
    if isinstance(given, str):
        if given not in INITIALISERS:
            raise ValueError(f"unknown initialiser {given!r}; known: {', '.join(INITIALISERS)}")
        given = INITIALISERS[given]
    return np.asarray(given(rows, columns, seed) if callable(given) else given, float)


class Configured:
    """Remembers what a layer was made with. ``config`` gives it as plain values, ``from_config`` makes the layer again."""

    known: dict[str, type] = {}

    def __init_subclass__(cls, **how):
        super().__init_subclass__(**how)
        Configured.known[cls.__name__] = cls

    def __new__(cls, *args, **how):
        self = super().__new__(cls)
        bound = inspect.signature(cls.__init__).bind(self, *args, **how)
        bound.apply_defaults()
        self._given = {k: v for k, v in list(bound.arguments.items())[1:] if k != "weights"}
        return self

    def config(self) -> dict:
        """The layer's name and arguments; functions by their names (``keywords.register`` makes these known), weights apart (``save``)."""
        plain = lambda v: getattr(v, "__name__", str(v)) if callable(v) else v.tolist() if isinstance(v, np.ndarray) else v
        return {"layer": type(self).__name__} | {k: plain(v) for k, v in self._given.items()}


def from_config(config: dict, weights: dict | None = None):
    """The layer that ``config`` describes, with these weights."""
    how = {k: v for k, v in config.items() if k != "layer"}
    if config["layer"] not in Configured.known:
        raise ValueError(f"unknown layer {config['layer']!r}")
    cls = Configured.known[config["layer"]]
    return cls(**how, **({"weights": weights} if "weights" in inspect.signature(cls.__init__).parameters else {}))


def save(spark: SparkSession, path: str, weights: dict[str, dict[str, np.ndarray]]) -> None:
    """{layer: {name: vector or matrix}} as rows (layer, name, i, j, value); j is null for vectors."""
    rows = []
    for layer, own in weights.items():
        for name, w in own.items():
            w = np.asarray(w, float)
            rows += [(layer, name, int(i[0]), int(i[1]) if w.ndim == 2 else None, float(v)) for i, v in np.ndenumerate(w)]
    table(spark, rows).write.mode("overwrite").parquet(path)


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "layer string, name string, i int, j int, value double")


def load(spark: SparkSession, path: str) -> dict[str, dict[str, np.ndarray]]:
    out: dict = {}
    for r in spark.read.parquet(path).collect():  # parameters, not data
        out.setdefault(r["layer"], {}).setdefault(r["name"], []).append((r["i"], r["j"], r["value"]))
    made: dict = {}
    for layer, own in out.items():
        for name, cells in own.items():
            vector = cells[0][1] is None
            shape = (max(c[0] for c in cells) + 1,) if vector else (max(c[0] for c in cells) + 1, max(c[1] for c in cells) + 1)
            w = np.zeros(shape)
            for i, j, v in cells:
                w[i if vector else (i, j)] = v
            made.setdefault(layer, {})[name] = w
    return made
