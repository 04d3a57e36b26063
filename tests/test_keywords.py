"""Keywords of layers as plain data and back, registered functions, and types of weights."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions.vectors import ACTIVATIONS
from weft.operators import convolutions as C
from weft.operators import training
from weft.operators.keywords import KINDS, is_framework_keyword, is_layer_keyword, register, spec_of, split, value_of
from weft.operators.params import from_config, glorot_uniform
from weft.sources.graph import Graph


def test_which_keywords_are_whose():
    assert all(map(is_layer_keyword, ("activation", "use_bias", "kernel_initializer", "bias_regularizer", "attn_kernel_constraint")))
    assert all(map(is_framework_keyword, ("name", "dtype", "trainable", "activity_regularizer")))
    assert not is_layer_keyword("activity_regularizer")
    assert not is_layer_keyword("channels")
    assert split({"use_bias": False, "name": "a", "kernel_initializer": "zeros"}) == ({"use_bias": False, "kernel_initializer": "zeros"}, {"name": "a"})
    with pytest.raises(ValueError, match="unknown keywords"):
        split({"chanels": 3})


@pytest.mark.parametrize(("key", "spec"), [("activation", "relu"), ("kernel_initializer", "glorot_uniform"), ("kernel_regularizer", {"name": "l2", "k": 0.25}), ("bias_constraint", {"name": "max_norm", "limit": 2.0}), ("kernel_constraint", {"name": "unit_norm"}), ("use_bias", False), ("activation", None)])
def test_there_and_back(key, spec):
    value = value_of(key, spec)
    assert spec_of(key, value) == spec
    json.dumps(spec_of(key, value))


def test_values_do_what_they_say():
    w = np.array([[3.0, -1.0], [4.0, 0.0]])
    assert value_of("kernel_initializer", "glorot_uniform") is glorot_uniform
    assert value_of("kernel_regularizer", {"name": "l2", "k": 0.5})(w)[0] == 13.0
    np.testing.assert_allclose(value_of("kernel_constraint", {"name": "max_norm", "limit": 1.0})(w), [[0.6, -1.0], [0.8, 0.0]])
    assert spec_of("kernel_constraint", training.non_negative) == {"name": "non_negative"}
    assert value_of("activation", F.abs) is F.abs
    with pytest.raises(ValueError, match="unknown activation"):
        value_of("activation", "swish")
    with pytest.raises(ValueError, match="no name"):
        spec_of("activation", lambda a: a)


def test_registered_functions_survive_a_configuration(spark):
    double = lambda a: F.transform(a, lambda x: 2 * x)
    double.__name__ = "double"
    register("activation", "double", double)
    g = Graph(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "node long, x array<double>"), spark.createDataFrame([(0, 1)], "src long, dst long"), 1)
    layer = C.GraphConvolution(1, activation=double, weights={"kernel": [[1.0]], "bias": [0.0]})
    again = from_config(json.loads(json.dumps(layer.config())), {"kernel": [[1.0]], "bias": [0.0]})
    assert {r["node"]: r["h"] for r in again(g).collect()} == {0: [0.0], 1: [2.0]}
    del ACTIVATIONS["double"]
    with pytest.raises(ValueError, match="unknown kind"):
        register("loss", "x", double)
    assert "activation" in KINDS


def test_integer_weights_are_cast_with_a_warning(spark):
    nodes = spark.createDataFrame([(0, [1.0])], "node long, x array<double>")
    with pytest.warns(UserWarning, match="cast to double"):
        g = Graph(nodes, spark.createDataFrame([(0, 0, 2)], "src long, dst long, w int"), 1)
    assert dict(g.edges.dtypes)["w"] == "double"
