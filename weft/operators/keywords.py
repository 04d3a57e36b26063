"""Keywords of layers: which belong to a layer's formula, and their values as plain data and back.

A value is named in a registry, with arguments where it is made from some: ``"relu"``, ``{"name": "l2", "k": 0.01}``. Functions of your
own join in by ``register``, so that configurations that name them can be made into layers again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from weft.functions.vectors import ACTIVATIONS

from . import training
from .params import INITIALISERS

# Keywords of a layer's formula, besides those that end as KINDS do, and keywords of the framework around it.
LAYER_KEYWORDS = {"activation", "use_bias"}
FRAMEWORK_KEYWORDS = {"trainable", "name", "dtype", "dynamic", "input_dim", "input_shape", "batch_input_shape", "batch_size", "weights", "activity_regularizer", "autocast", "implementation"}

#: {ending: registry}; makers take the arguments that follow the name.
KINDS: dict[str, dict[str, Callable]] = {
    "_initializer": INITIALISERS,
    "_regularizer": {"l1": training.l1, "l2": training.l2},
    "_constraint": {"max_norm": training.max_norm, "unit_norm": lambda: training.unit_norm, "non_negative": lambda: training.non_negative},
    "activation": ACTIVATIONS,
}
_MADE = {"_regularizer", "_constraint"}


def is_framework_keyword(key: str) -> bool:
    return key in FRAMEWORK_KEYWORDS


def is_layer_keyword(key: str) -> bool:
    return not is_framework_keyword(key) and (key in LAYER_KEYWORDS or any(key.endswith(end) for end in KINDS if end != "activation"))


def split(how: dict) -> tuple[dict, dict]:
    """Keywords of the layer and of the framework; any other raises."""
    if unknown := [k for k in how if not (is_layer_keyword(k) or is_framework_keyword(k))]:
        raise ValueError(f"unknown keywords {unknown}")
    return {k: v for k, v in how.items() if is_layer_keyword(k)}, {k: v for k, v in how.items() if is_framework_keyword(k)}


def _kind(key: str) -> str | None:
    return "activation" if key == "activation" else next((end for end in KINDS if key.endswith(end)), None)


def register(kind: str, name: str, f: Callable) -> None:
    """Name a function: of columns for ``activation``, of (rows, columns, seed) for ``_initializer``, a maker for the others."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind!r}; known: {', '.join(KINDS)}")
    KINDS[kind][name] = f


class Named:
    """A regulariser or constraint that remembers what it was made from."""

    def __init__(self, spec: dict, f: Callable):
        self.spec, self.f = spec, f

    def __call__(self, w: np.ndarray):
        return self.f(w)


def value_of(key: str, spec):
    """The value of a keyword from plain data; what isn't named (functions, arrays, None) stays as it is."""
    kind = _kind(key)
    if kind is None or spec is None or not isinstance(spec, (str, dict)):
        return spec
    spec = {"name": spec} if isinstance(spec, str) else dict(spec)
    how = dict(spec)
    name = how.pop("name")
    if name not in KINDS[kind]:
        raise ValueError(f"unknown {key} {name!r}; known: {', '.join(KINDS[kind])}")
    made = KINDS[kind][name]
    return Named(spec, made(**how)) if kind in _MADE else made


def spec_of(key: str, value):
    """Plain data for the value of a keyword; the inverse of ``value_of``. A function without a name raises."""
    kind = _kind(key)
    if isinstance(value, Named):
        return value.spec
    if kind is None or value is None or isinstance(value, (str, dict)):
        return value
    if isinstance(value, np.ndarray):
        return value.tolist()
    for name, f in KINDS[kind].items():
        if f is value or (kind in _MADE and name in ("unit_norm", "non_negative") and f() is value):
            return {"name": name} if kind in _MADE else name
    raise ValueError(f"{value!r} has no name as {key}; register it first")
