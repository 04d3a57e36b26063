"""Reverse mode over joins against finite differences of a plain numpy model, and training."""

import numpy as np
import pytest

from weft.operators.training import Adam, Dense, Drop, Edges, Model, Pad, gated, l1, l2, max_norm, non_negative, unit_norm
from weft.sources.graph import Graph

N, DIM, CLASSES = 14, 3, 3


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((N, DIM))
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, N - 1, (40, 2))})  # the last node is alone
    w = rng.random(len(pairs)) + 0.5
    label = [None if i % 5 == 4 else int(i % CLASSES) for i in range(N)]
    mask = [i % 7 != 3 for i in range(N)]
    nodes = spark.createDataFrame([(i, label[i], mask[i], v) for i, v in enumerate(x.tolist())], "node long, label int, mask boolean, x array<double>").repartition(3)
    edges = spark.createDataFrame([(a, b, float(v)) for (a, b), v in zip(pairs, w, strict=True)], "src long, dst long, w double")
    a, b = np.zeros((N, N)), np.zeros((N, N))
    for (p, q), v in zip(pairs, w, strict=True):
        a[p, q], b[p, q] = 1, v
    return Graph(nodes, edges, DIM), x, a, b, label, mask


def steps():
    """Dense, padding, a gated layer of two steps, a weighted product, and a dense layer that reads two stages back."""
    return [Dense("first", "x", "f", 2, "tanh"), Pad("f", "h", 4), *gated("g", "h", "h2", 2), Dense("mid", "h2", "m", 3, "sigmoid"), Edges("m", "e", "dst", "src", weigh=True), Dense("last", "e", "y", CLASSES)]


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def brute_loss(p, x, a, b, label, mask):
    h = np.pad(np.tanh(x @ p["first/w"] + p["first/b"]), ((0, 0), (0, 2)))
    for k in range(2):
        m = a.T @ (h @ p[f"g/{k}/w"])
        u, v = m @ p["g/gru/kernel"] + p["g/gru/bias"], h @ p["g/gru/recurrent"] + p["g/gru/recurrent_bias"]
        z, r = sigmoid(u[:, :4] + v[:, :4]), sigmoid(u[:, 4:8] + v[:, 4:8])
        h = z * h + (1 - z) * np.tanh(u[:, 8:] + r * v[:, 8:])
    y = b @ sigmoid(h @ p["mid/w"] + p["mid/b"]) @ p["last/w"] + p["last/b"]
    own = [i for i in range(N) if label[i] is not None and mask[i]]
    log = y - np.log(np.exp(y).sum(axis=1, keepdims=True))
    return -np.mean([log[i, label[i]] for i in own])


def test_gradients_equal_finite_differences(small):
    g, x, a, b, label, mask = small
    model = Model(steps(), DIM, "y", seed=3)
    layouts = model.layouts(g)
    rows = model.forward(g.nodes, layouts)
    loss, n = model.loss(rows)
    assert n == sum(v is not None and m for v, m in zip(label, mask, strict=True))
    assert loss == pytest.approx(brute_loss(model.params, x, a, b, label, mask), abs=1e-12)
    grads = model.gradients(rows, layouts, n)
    assert set(grads) == set(model.params)
    for name, own in grads.items():
        for at in np.ndindex(own.shape):
            p = {k: v.copy() for k, v in model.params.items()}
            p[name][at] += 1e-5
            up = brute_loss(p, x, a, b, label, mask)
            p[name][at] -= 2e-5
            assert own[at] == pytest.approx((up - brute_loss(p, x, a, b, label, mask)) / 2e-5, abs=1e-7), (name, at)


def test_loss_falls_and_the_state_is_a_table(spark, small):
    g, x, a, b, label, mask = small
    model = Model(steps(), DIM, "y", seed=3)
    adam = Adam(rate=0.02)
    losses = model.fit(g, 6, adam)
    assert losses[0] == pytest.approx(brute_loss(Model(steps(), DIM, "y", seed=3).params, x, a, b, label, mask), abs=1e-12)
    assert losses[-1] < losses[0] - 0.02
    assert brute_loss(model.params, x, a, b, label, mask) < losses[0] - 0.02
    rows = adam.state(spark, model.params).collect()
    assert {r["layer"] for r in rows} == {"adam", "params", "m", "v"}
    assert sum(r["layer"] == "params" for r in rows) == sum(w.size for w in model.params.values())
    out = model.predict(g)
    assert out.columns == ["node", "label", "mask", "h"]
    assert out.count() == N


def test_regularisers_and_constraints(small):
    g, *_ = small
    plain = lambda **how: Model([Dense("first", "x", "f", 4, "relu"), Edges("f", "e"), Dense("last", "e", "y", CLASSES)], DIM, "y", seed=1, **how)
    base = plain()
    model = plain(regularisers={"first/w": l2(0.5), "last/w": l1(0.1)}, constraints={"first/w": max_norm(0.3), "last/w": unit_norm, "first/b": non_negative})
    w1, w2 = model.params["first/w"], model.params["last/w"]
    layouts = base.layouts(g)
    rows = base.forward(g.nodes, layouts)
    penalty = 0.5 * (w1**2).sum() + 0.1 * np.abs(w2).sum()
    loss = model.step(g.nodes, layouts, Adam(rate=0.5))
    assert loss == pytest.approx(base.loss(rows)[0] + penalty, abs=1e-12)
    assert np.sqrt((model.params["first/w"] ** 2).sum(axis=0)).max() <= 0.3 + 1e-12
    np.testing.assert_allclose((model.params["last/w"] ** 2).sum(axis=0), 1, atol=1e-12)
    assert (model.params["first/b"] >= 0).all()


def test_drawn_dropout_and_missing_labels(spark, small):
    g, *_ = small
    model = Model([Drop("x", "d", 0.5), Dense("last", "d", "y", CLASSES)], DIM, "y")
    plain, one, again, other = (sorted(map(str, model.forward(g.nodes, {}, d).select("node", "d").collect())) for d in (None, 1, 1, 2))
    assert one == again
    assert one != other
    assert one != plain
    none = Graph(g.nodes.selectExpr("node", "cast(null as int) label", "x"), g.edges, DIM)
    before = {k: v.copy() for k, v in model.params.items()}
    assert model.fit(none, 1) == [None]
    assert all((before[k] == model.params[k]).all() for k in before)
    with pytest.raises(ValueError, match="read before"):
        Model([Dense("a", "z", "y", 2)], DIM, "y")
