"""Loss operators: NumPy and column forms agree, gradients match finite differences,
K=2 multinomial equals binary logistic, extreme margins stay finite."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeline.functions.losses import LeastSquaresLoss, LogisticLoss, HingeLoss, MultinomialLoss, resolve_loss

RNG = np.random.default_rng(7)


def _loss_at(loss, x, y, w):
    k = loss.outputs
    l, _ = loss.numpy(x @ w.reshape(k, -1).T, y)
    return l


@pytest.mark.parametrize("loss", [LogisticLoss(), LeastSquaresLoss(), MultinomialLoss(4)])
def test_gradient_matches_finite_differences(loss):
    d = 5
    x = RNG.normal(size=(20, d))
    y = RNG.integers(0, 4 if loss.outputs > 1 else 2, size=20).astype(float)
    w = RNG.normal(size=loss.slots(d)) * 0.3
    _, mult = loss.numpy(x @ w.reshape(loss.outputs, d).T, y)
    grad = (mult.T @ x).ravel()
    eps = 1e-6
    for s in range(len(w)):
        e = np.zeros_like(w)
        e[s] = eps
        fd = (_loss_at(loss, x, y, w + e).sum() - _loss_at(loss, x, y, w - e).sum()) / (2 * eps)
        assert abs(fd - grad[s]) < 1e-5


def test_hinge_subgradient():
    loss = HingeLoss()
    l, m = loss.numpy(np.array([[0.5], [2.0], [-0.5]]), np.array([1.0, 1.0, 0.0]))
    assert np.allclose(l, [0.5, 0.0, 0.5])
    assert np.allclose(m[:, 0], [-1.0, 0.0, 1.0])


def test_multinomial_two_classes_equals_binary():
    x = RNG.normal(size=(30, 4))
    y = RNG.integers(0, 2, size=30).astype(float)
    w = RNG.normal(size=4)
    lb, mb = LogisticLoss().numpy((x @ w)[:, None], y)
    lm, mm = MultinomialLoss(2).numpy((x @ w)[:, None], y)
    assert np.allclose(lb, lm, atol=1e-12)
    assert np.allclose(mb, mm, atol=1e-12)


@pytest.mark.parametrize("loss", [LogisticLoss(), MultinomialLoss(3)])
def test_extreme_margins_stay_finite(loss):
    z = np.array([[800.0] * loss.outputs, [-800.0] * loss.outputs, [710.5] * loss.outputs])
    y = np.array([0.0, 1.0, 1.0])
    l, m = loss.numpy(z, y)
    assert np.all(np.isfinite(l)) and np.all(np.isfinite(m))


@pytest.mark.parametrize("name,k", [("logistic", 2), ("least_squares", 2), ("hinge", 2), ("multinomial", 3)])
def test_column_form_equals_numpy_form(spark, name, k):
    loss = resolve_loss(name, k)
    z = RNG.normal(size=(12, loss.outputs)) * 3
    z[0] = 750.0
    y = RNG.integers(0, k, size=12).astype(float)
    rows = [(float(y[i]), [float(v) for v in z[i]]) for i in range(12)]
    df = spark.createDataFrame(rows, "y DOUBLE, z ARRAY<DOUBLE>")
    loss_col, mults = loss.columns([F.col("z")[c] for c in range(loss.outputs)], F.col("y"))
    got = df.select(loss_col.alias("l"), *[m.alias(f"m{c}") for c, m in enumerate(mults)]).collect()
    l_np, m_np = loss.numpy(z, y)
    for i, r in enumerate(got):
        assert r["l"] == pytest.approx(l_np[i], rel=1e-12, abs=1e-12)
        for c in range(loss.outputs):
            assert r[f"m{c}"] == pytest.approx(m_np[i, c], rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("loss", [LogisticLoss(), LeastSquaresLoss(), HingeLoss()])
def test_scalar_form_equals_numpy_form(loss):
    for z in (-900.0, -3.0, -0.5, 0.0, 0.7, 5.0, 800.0):
        for y in (0.0, 1.0):
            l_np, m_np = loss.numpy(np.array([[z]]), np.array([y]))
            l_s, m_s = loss.scalar(z, y)
            assert l_s == pytest.approx(float(l_np[0]), rel=1e-12, abs=1e-12)
            assert m_s == pytest.approx(float(m_np[0, 0]), rel=1e-12, abs=1e-12)


def test_package_helpers(spark, fx1, fx1_np):
    import slopeline

    _, x, y = fx1_np
    w = np.linspace(-0.1, 0.1, 64)
    g = {r["idx"]: r["grad"] for r in slopeline.batch_gradient(fx1, w).collect()}
    want = ((1 / (1 + np.exp(-(x @ w))) - y) @ x) / len(y)
    assert np.allclose([g[i] for i in range(64)], want, atol=1e-13)
    rl = slopeline.row_loss(fx1, w).orderBy("key").collect()
    z = x @ w
    assert np.allclose([r["loss"] for r in rl], np.logaddexp(0, -z) + (1 - y) * z, atol=1e-12)
