"""Update rules against hand-written NumPy formulas, both variants; the same rules on
Spark columns give the same numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeline.operators.updates import ColumnOps, StepContext, apply_rule, init_state, penalised_step

RNG = np.random.default_rng(3)
W = RNG.normal(size=6)
G = RNG.normal(size=6)


def test_plain_l1_l2_steps():
    eta = 0.5 / math.sqrt(4)
    assert np.allclose(penalised_step(W, G, eta, 0.3, "none"), W - eta * G)
    u = W - eta * G
    assert np.allclose(penalised_step(W, G, eta, 0.3, "l1"), np.sign(u) * np.maximum(0, np.abs(u) - 0.3 * eta))
    assert np.allclose(penalised_step(W, G, eta, 0.3, "l2"), (1 - eta * 0.3) * W - eta * G)
    assert np.allclose(penalised_step(W, G, eta, 0.0, "l2"), penalised_step(W, G, eta, 0.0, "none"))


def _run(method, variant, steps=4, reg=0.1, step=0.2):
    w = W.copy()
    state = init_state(method, w)
    out = []
    for t in range(steps):
        g = G * (t + 1) * 0.5
        w, state = apply_rule(method, w, g, state, StepContext(i=t + 1, t=t, step=step, reg=reg, variant=variant))
        out.append(w)
    return out


def test_momentum_variants():
    reg, step = 0.1, 0.2
    ws = [W.copy()]
    for t in range(4):
        g = G * (t + 1) * 0.5
        eta = step / math.sqrt(t + 1)
        w = ws[-1]
        if t == 0:
            new = (1 - eta * reg) * w - eta * g
        elif t == 1:
            new = (1 - eta * reg) * w - eta * (g - w)
        else:
            new = (1 - eta * reg) * w - eta * (g - 0.9 * eta * (w - ws[-2]))
        ws.append(new)
    assert np.allclose(_run("momentum", "observed")[-1], ws[-1])
    hb = [W.copy()]
    for t in range(4):
        g = G * (t + 1) * 0.5
        eta = step / math.sqrt(t + 1)
        w = hb[-1]
        new = (1 - eta * reg) * w - eta * g + (0.9 * (w - hb[-2]) if t else 0.0)
        hb.append(new)
    assert np.allclose(_run("momentum", "published")[-1], hb[-1])


def test_adagrad():
    w, gsq = W.copy(), np.zeros(6)
    for t in range(4):
        g = G * (t + 1) * 0.5
        gsq += g * g
        e = 1 / np.sqrt(gsq + 1e-6)
        w = (1 - 0.2 * 0.1 * e) * w - 0.2 * e * g
    assert np.allclose(_run("adagrad", "published")[-1], w)


@pytest.mark.parametrize("variant", ["observed", "published"])
def test_adadelta(variant):
    w, e2, d2 = W.copy(), np.zeros(6), np.zeros(6)
    for t in range(4):
        g = G * (t + 1) * 0.5 + 0.1 * w
        e2 = 0.95 * e2 + 0.05 * g * g
        tx = np.sqrt(d2 + 1e-6) / np.sqrt(e2 + 1e-6) * g
        d2 = 0.95 * d2 + 0.05 * tx * tx
        w = w + d2 if variant == "observed" else w - tx
    assert np.allclose(_run("adadelta", variant)[-1], w)


@pytest.mark.parametrize("variant", ["observed", "published"])
def test_adam(variant):
    w, m, v = W.copy(), np.zeros(6), np.zeros(6)
    for t in range(4):
        g = G * (t + 1) * 0.5 + 0.1 * w
        v = 0.99 * v + 0.01 * g * g
        m = 0.9 * m + 0.1 * g
        if variant == "observed":
            w = w - 0.2 * (m / 0.1) / (np.sqrt(v / 0.01) + 1e-8)
        else:
            w = w - 0.2 * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.99 ** (t + 1))) + 1e-8)
    assert np.allclose(_run("adam", variant)[-1], w)


@pytest.mark.parametrize("method,variant", [("sgd", "published"), ("momentum", "observed"), ("adagrad", "published"),
                                            ("adadelta", "published"), ("adam", "observed")])
def test_column_rules_equal_array_rules(spark, method, variant):
    ctx = StepContext(i=3, t=2, step=0.2, reg=0.1, variant=variant)
    state_np = {k: v + 0.3 for k, v in init_state(method, W).items()}
    want, _ = apply_rule(method, W, G, state_np, ctx)
    rows = [(i, float(W[i]), float(G[i]), *[float(state_np[k][i]) for k in state_np]) for i in range(6)]
    schema = "idx INT, w DOUBLE, g DOUBLE" + "".join(f", {k} DOUBLE" for k in state_np)
    df = spark.createDataFrame(rows, schema)
    new, _ = apply_rule(method, F.col("w"), F.col("g"), {k: F.col(k) for k in state_np}, ctx, ops=ColumnOps)
    got = {r["idx"]: r["nw"] for r in df.select("idx", new.alias("nw")).collect()}
    assert np.allclose([got[i] for i in range(6)], want, rtol=1e-13, atol=1e-15)
