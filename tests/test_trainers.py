"""Trainers: against pyspark.mllib, NumPy replays of the SVRG walks, layout independence,
convergence, and the edge tables."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeline.operators.trainers import TrainConfig, fit

from conftest import SF_CHECK


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


def test_sgd_matches_mllib(spark, fx1):
    from pyspark.mllib.classification import LogisticRegressionWithSGD
    from pyspark.mllib.regression import LabeledPoint

    rdd = fx1.rdd.map(lambda r: LabeledPoint(r["label"], [float(v) for v in r["features"]]))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        ref = LogisticRegressionWithSGD.train(rdd, iterations=5, step=1.0, miniBatchFraction=1.0, regParam=1.0,
                                              regType="l2", intercept=False, convergenceTol=0.0)
    ours = fit(fx1, TrainConfig(method="sgd", penalty="l2", reg=1.0, step=1.0, iters=5, tol=0.0))
    assert np.allclose(ours.weights, ref.weights.toArray(), rtol=1e-10, atol=1e-13)


def test_sgd_matches_numpy_and_history(fx1, fx1_np):
    _, x, y = fx1_np
    w = np.zeros(64)
    hist = []
    reg_val = 0.0
    for i in range(1, 4):
        z = x @ w
        loss = np.logaddexp(0, -z) + (1 - y) * z
        hist.append(loss.mean() + reg_val)
        g = (_sigmoid(z) - y) @ x / len(y)
        eta = 1 / math.sqrt(i)
        w = (1 - eta * 0.5) * w - eta * g
        reg_val = 0.25 * w @ w
    res = fit(fx1, TrainConfig(method="sgd", penalty="l2", reg=0.5, iters=3, tol=0.0))
    assert np.allclose(res.weights, w, atol=1e-14)
    assert np.allclose(res.loss_history, hist, atol=1e-12)
    assert res.last_losses(2) == res.loss_history[-2:]


@pytest.mark.parametrize("method", ["sgd", "momentum", "adagrad", "adadelta", "adam"])
def test_keyed_batches_do_not_depend_on_layout(fx1, method):
    cfg = TrainConfig(method=method, penalty="l2", reg=0.1, step=0.1, iters=3, fraction=0.4, tol=0.0, sample_by="key")
    runs = [fit(fx1.repartition(p), cfg).weights for p in (1, 4, 7)]
    assert np.allclose(runs[0], runs[1], atol=1e-13) and np.allclose(runs[0], runs[2], atol=1e-13)


def _grad(x, y, w):
    return (_sigmoid(x @ w) - y)[:, None] * x


def test_svrg_avg_matches_numpy(fx1, fx1_np):
    keys, x, y = fx1_np
    step, reg, shards = 0.1, 0.1, 4
    w = np.zeros(64)
    for i in range(1, 3):
        eta = step / math.sqrt(i)
        mu = _grad(x, y, w).mean(axis=0)
        outs = []
        for s in range(shards):
            idx = np.where(keys % shards == s)[0]
            wl = w.copy()
            g0 = _grad(x[idx], y[idx], w)
            for r, row in enumerate(idx):
                f = _grad(x[row:row + 1], y[row:row + 1], wl)[0] - g0[r] + mu
                wl = (1 - eta * reg) * wl - eta * f
            outs.append(wl)
        w = np.mean(outs, axis=0)
    res = fit(fx1, TrainConfig(method="svrg_avg", penalty="l2", reg=reg, step=step, iters=2, tol=0.0, order="key",
                               shard_by="key_mod", shards=shards))
    assert np.allclose(res.weights, w, atol=1e-13)


def test_svrg_matches_numpy(fx1, fx1_np):
    keys, x, y = fx1_np
    step, reg, shards = 0.1, 0.1, 4
    w = np.zeros(64)
    for i in range(1, 3):
        eta = step / math.sqrt(i)
        total, n = np.zeros(64), 0
        for s in range(shards):
            idx = np.where(keys % shards == s)[0]
            g0 = _grad(x[idx], y[idx], w)
            mu = g0.mean(axis=0)
            wl = w.copy()
            for r, row in enumerate(idx):
                f = _grad(x[row:row + 1], y[row:row + 1], wl)[0] - g0[r] + mu
                total += f
                wl = (1 - eta * reg) * wl - eta * f
            n += len(idx)
        w = (1 - eta * reg) * w - eta * total / n
    res = fit(fx1, TrainConfig(method="svrg", penalty="l2", reg=reg, step=step, iters=2, tol=0.0, order="key",
                               shard_by="key_mod", shards=shards))
    assert np.allclose(res.weights, w, atol=1e-13)


def test_svrg_random_walk_is_reproducible(fx1):
    # hashed shards are salted by the row id of the input splits: same input, same result
    cfg = TrainConfig(method="svrg", penalty="l2", reg=0.1, step=0.1, iters=2, tol=0.0, shards=3)
    assert np.array_equal(fit(fx1, cfg).weights, fit(fx1, cfg).weights)
    # shards by key are independent of the layout as well
    cfg = TrainConfig(method="svrg", penalty="l2", reg=0.1, step=0.1, iters=2, tol=0.0, shards=3, shard_by="key_mod")
    assert np.allclose(fit(fx1, cfg).weights, fit(fx1.repartition(5), cfg).weights, atol=1e-13)


def test_hashed_shards_spread_copied_rows(spark):
    from slopeline.operators.svrg import shard_column
    from slopeline.operators.trainers import prepare

    copies = spark.createDataFrame([(7, 1.0, [1.0, 2.0])] * 600, "key BIGINT, label DOUBLE, features ARRAY<DOUBLE>")
    cfg = TrainConfig(method="svrg", shards=6)
    sizes = prepare(copies, row_ids=True).groupBy(shard_column(cfg, 6).alias("s")).count().collect()
    assert len(sizes) == 6 and max(r["count"] for r in sizes) < 200


def test_svrg_avg_one_row_shards_equal_full_batch_l2_step(spark):
    rows = [(k, float(k % 2), [0.1 * k, 1.0, -0.2 * k]) for k in range(6)]
    df = spark.createDataFrame(rows, "key BIGINT, label DOUBLE, features ARRAY<DOUBLE>")
    res = fit(df, TrainConfig(method="svrg_avg", penalty="l2", reg=0.2, step=0.5, iters=1, tol=0.0, order="key",
                              shard_by="key_mod", shards=6))
    ref = fit(df, TrainConfig(method="sgd", penalty="l2", reg=0.2, step=0.5, iters=1, tol=0.0))
    assert np.allclose(res.weights, ref.weights, atol=1e-14)


def test_convergence_stops_early(fx1, fx1_np):
    _, x, y = fx1_np
    w, prev, stop = np.zeros(64), None, None
    for i in range(1, 51):
        g = (_sigmoid(x @ w) - y) @ x / len(y)
        eta = 1 / math.sqrt(i)
        new = (1 - eta * 0.1) * w - eta * g
        if i >= 2 and np.linalg.norm(new - w) < 0.25 * max(np.linalg.norm(new), 1.0):
            stop = i
            break
        w = new
    res = fit(fx1, TrainConfig(method="sgd", penalty="l2", reg=0.1, iters=50, tol=0.25))
    assert res.converged and res.iterations == stop and len(res.history) == stop


def test_multinomial_with_two_classes_equals_binary(fx1):
    a = fit(fx1, TrainConfig(method="sgd", penalty="l2", reg=0.1, iters=3, tol=0.0))
    b = fit(fx1, TrainConfig(loss="multinomial", num_classes=2, method="sgd", penalty="l2", reg=0.1, iters=3, tol=0.0))
    assert np.allclose(a.weights, b.weights, atol=1e-13)


def test_intercept_is_split_out(fx1):
    res = fit(fx1, TrainConfig(method="sgd", penalty="l2", reg=0.1, iters=2, tol=0.0, intercept=True))
    assert len(res.model.weights) == 64 and res.model.intercept == res.weights[-1]


def test_wide_equals_dense(spark, fx1):
    from slopeline.operators.wide import fit_wide

    entries = fx1.select("key", F.posexplode("features").alias("idx", "value"))
    for method in ("sgd", "momentum", "adam"):
        cfg = TrainConfig(method=method, penalty="l2", reg=0.1, step=0.1, iters=3, tol=0.0, fraction=0.6,
                          sample_by="key")
        dense = fit(fx1, cfg).weights
        wide = fit_wide(entries, fx1.select("key", "label"), cfg, num_features=64)
        got = np.array([r["weight"] for r in wide.weights.orderBy("idx").collect()])
        assert np.allclose(got, dense, atol=1e-12)


# --- edges ---------------------------------------------------------------------------------

def test_empty_input_returns_initial_weights(fx1):
    with pytest.warns(UserWarning):
        res = fit(fx1.where("label > 1"), TrainConfig(iters=3), initial_weights=np.ones(64))
    assert np.array_equal(res.weights, np.ones(64)) and res.history == []


def test_empty_batches_keep_weights(fx1):
    with pytest.warns(UserWarning):
        res = fit(fx1, TrainConfig(iters=2, fraction=1e-12, tol=0.0, sampler="md5"), initial_weights=np.full(64, 0.5))
    assert np.array_equal(res.weights, np.full(64, 0.5)) and res.updates == 0


def _small(spark, rows, schema="key BIGINT, label DOUBLE, features ARRAY<DOUBLE>"):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("rows,msg", [
    ([(1, None, [1.0, 2.0]), (2, 1.0, [0.0, 1.0])], "null label"),
    ([(1, 1.0, None), (2, 0.0, [0.0, 1.0])], "null feature"),
    ([(1, 1.0, [1.0, None]), (2, 0.0, [0.0, 1.0])], "null feature"),
    ([(1, 1.0, [1.0, 2.0, 3.0]), (2, 0.0, [0.0, 1.0])], "differ in length"),
    ([(1, 2.0, [1.0, 2.0]), (2, 0.0, [0.0, 1.0])], "labels are not"),
])
def test_bad_tables_are_rejected(spark, rows, msg):
    with pytest.raises(ValueError, match=msg):
        fit(_small(spark, rows), TrainConfig(iters=1))


def test_single_row_and_single_class(spark):
    res = fit(_small(spark, [(1, 1.0, [1.0, 2.0])]), TrainConfig(iters=2, tol=0.0))
    assert res.rows == 1 and np.all(res.weights > 0)
    res = fit(_small(spark, [(k, 0.0, [1.0, float(k)]) for k in range(5)]), TrainConfig(iters=2, tol=0.0))
    assert np.all(np.isfinite(res.weights))


def test_huge_margins_stay_finite(spark):
    df = _small(spark, [(1, 1.0, [1000.0, -800.0]), (2, 0.0, [900.0, 750.0])])
    res = fit(df, TrainConfig(iters=3, tol=0.0), initial_weights=np.array([1.0, 1.0]))
    assert np.all(np.isfinite(res.weights)) and all(np.isfinite(res.loss_history))


@pytest.mark.parametrize("kw", [dict(step=0), dict(fraction=0), dict(fraction=1.5), dict(iters=-1), dict(reg=-1),
                                dict(tol=2), dict(method="lbfgs"), dict(method="adam", penalty="l1")])
def test_config_is_checked(kw):
    with pytest.raises(ValueError):
        TrainConfig(**kw)


def test_wide_rejects_repeated_keys(spark):
    from slopeline.operators.wide import fit_wide

    entries = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0)], "key BIGINT, idx INT, value DOUBLE")
    labels = spark.createDataFrame([(1, 1.0), (1, 0.0), (2, 0.0)], "key BIGINT, label DOUBLE")
    with pytest.raises(ValueError, match="one label row per key"):
        fit_wide(entries, labels, TrainConfig(iters=1))


def test_unpenalised_intercept_matches_numpy(fx1, fx1_np):
    _, x, y = fx1_np
    xb = np.hstack([x, np.ones((len(y), 1))])
    mask = np.r_[np.full(64, 0.5), 0.0]
    w = np.zeros(65)
    for i in range(1, 4):
        g = (_sigmoid(xb @ w) - y) @ xb / len(y)
        eta = 1 / math.sqrt(i)
        w = (1 - eta * mask) * w - eta * g
    res = fit(fx1, TrainConfig(method="sgd", penalty="l2", reg=0.5, iters=3, tol=0.0, intercept=True,
                               penalise_bias=False))
    assert np.allclose(res.weights, w, atol=1e-14)
    assert res.model.intercept == pytest.approx(w[-1], abs=1e-15)
    # the reported penalty leaves the bias out
    from slopeline.operators.updates import penalty_value
    assert penalty_value(w, mask, "l2") == pytest.approx(0.25 * float(w[:64] @ w[:64]))


def test_table_without_key_gets_row_ids(spark):
    df = spark.createDataFrame([(float(k % 2), [1.0, 0.1 * k]) for k in range(20)], "label DOUBLE, features ARRAY<DOUBLE>")
    res = fit(df, TrainConfig(iters=2, tol=0.0, fraction=0.5))
    assert res.rows == 20 and np.all(np.isfinite(res.weights))


def test_svrg_avg_observed_counts_empty_shards(spark):
    rows = [(k, float(k % 2), [1.0, 0.2 * k]) for k in range(6)]
    df = spark.createDataFrame(rows, "key BIGINT, label DOUBLE, features ARRAY<DOUBLE>")
    x = np.array([r[2] for r in rows])
    y = np.array([r[1] for r in rows])
    eta, reg, shards = 0.5, 0.1, 8  # keys 0..5 fill six of the eight shards
    w = np.zeros(2)
    mu = _grad(x, y, w).mean(axis=0)
    outs = []
    for k in range(6):
        f = _grad(x[k:k + 1], y[k:k + 1], w)[0] - _grad(x[k:k + 1], y[k:k + 1], w)[0] + mu
        outs.append((1 - eta * reg) * w - eta * f)
    observed = (np.sum(outs, axis=0) + 2 * w) / 8
    published = np.mean(outs, axis=0)
    common = dict(method="svrg_avg", penalty="l2", reg=reg, step=eta, iters=1, tol=0.0, order="key",
                  shard_by="key_mod", shards=shards)
    assert np.allclose(fit(df, TrainConfig(variant="observed", **common)).weights, observed, atol=1e-14)
    assert np.allclose(fit(df, TrainConfig(**common)).weights, published, atol=1e-14)


@pytest.mark.parametrize("kernel", ["sums", "expr", "arrow"])
def test_kernels_agree(spark, fx1, kernel):
    from slopeline.sources import tables
    from conftest import SF_CHECK

    fx2 = tables.lineitem_returns(spark, SF_CHECK)
    ref = fit(fx2, TrainConfig(method="sgd", penalty="l2", reg=0.1, iters=2, tol=0.0, kernel="arrow")).weights
    got = fit(fx2, TrainConfig(method="sgd", penalty="l2", reg=0.1, iters=2, tol=0.0, kernel=kernel)).weights
    assert np.allclose(got, ref, rtol=1e-11, atol=1e-13)


@pytest.mark.parametrize("kernel", ["sums", "expr", "arrow"])
def test_null_entries_rejected_by_every_kernel(spark, kernel):
    df = _small(spark, [(1, 1.0, [1.0, None]), (2, 0.0, [0.0, 1.0])])
    with pytest.raises(ValueError, match="null feature"):
        fit(df, TrainConfig(iters=1, kernel=kernel))


def test_row_sampling_spreads_a_hot_key(spark):
    from slopeline.functions.sampling import keyed_sample
    from slopeline.operators.trainers import prepare

    # one key holds a third of the rows
    rows = [(0 if k % 3 == 0 else k, float(k % 2), [1.0, 0.01 * k]) for k in range(3000)]
    df = prepare(_small(spark, rows), row_ids=True).cache()
    for seed in (43, 44, 45):
        by_row = keyed_sample(df, "key", 0.3, seed, "xxhash64", "_rid").where("key = 0").count()
        assert 200 < by_row < 400  # about 0.3 of the 1,000 hot rows
    by_key = [keyed_sample(df, "key", 0.3, s, "xxhash64").where("key = 0").count() for s in range(43, 53)]
    assert set(by_key) <= {0, 1000}  # hashing the key alone takes the hot key whole or not at all
    res = fit(_small(spark, rows), TrainConfig(iters=3, fraction=0.3, tol=0.0))
    assert all(600 < h.batch_rows < 1200 for h in res.history)


def test_lazy_gradient_frames_agree_across_kernels(fx1):
    from slopeline.functions.losses import resolve_loss
    from slopeline.operators.gradient import mean_gradient_frame

    loss = resolve_loss("logistic")
    w = np.linspace(-0.2, 0.2, 64)
    frames = {k: {r["idx"]: r["grad"] for r in mean_gradient_frame(fx1, w, loss, 64, kernel=k).collect()}
              for k in ("arrow", "sums", "expr")}
    for k in ("sums", "expr"):
        assert frames[k].keys() == frames["arrow"].keys()
        assert np.allclose([frames[k][i] for i in range(64)], [frames["arrow"][i] for i in range(64)], atol=1e-13)


def test_merge_by_slot_path_equals_direct_path(fx1, monkeypatch):
    from slopeline.operators import gradient, svrg

    cfg = TrainConfig(method="sgd", penalty="l2", reg=0.1, iters=2, tol=0.0)
    direct = fit(fx1, cfg).weights
    monkeypatch.setattr(gradient, "DIRECT_MERGE_LIMIT", 1)
    monkeypatch.setattr(svrg, "DIRECT_MERGE_LIMIT", 1)
    merged = fit(fx1, cfg).weights
    assert np.allclose(direct, merged, atol=1e-14)
    cfg = TrainConfig(method="svrg_avg", penalty="l2", reg=0.1, step=0.1, iters=1, tol=0.0, shards=3)
    assert np.all(np.isfinite(fit(fx1, cfg).weights))


def test_vector_features_and_unvalidated_labels(spark, fx1):
    from pyspark.ml.functions import array_to_vector

    vec = fx1.select("key", "label", array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    cfg = TrainConfig(method="sgd", penalty="l2", reg=0.1, iters=2, tol=0.0)
    assert np.allclose(fit(vec, cfg).weights, fit(fx1, cfg).weights, atol=1e-15)
    df = _small(spark, [(1, 2.0, [1.0, 0.5]), (2, 0.0, [0.0, 1.0])])
    with pytest.raises(ValueError):
        fit(df, TrainConfig(iters=1))
    assert np.all(np.isfinite(fit(df, TrainConfig(iters=1, validate=False, tol=0.0)).weights))


def test_multinomial_kernels_agree(spark):
    rows = [(k, float(k % 3), [1.0, 0.1 * (k % 7), -0.05 * (k % 5)]) for k in range(60)]
    df = _small(spark, rows)
    cfg = dict(loss="multinomial", num_classes=3, method="sgd", penalty="l2", reg=0.1, iters=3, tol=0.0)
    ref = fit(df, TrainConfig(kernel="arrow", **cfg)).weights
    for kernel in ("sums", "expr"):
        assert np.allclose(fit(df, TrainConfig(kernel=kernel, **cfg)).weights, ref, atol=1e-13)


def test_bernoulli_batches_follow_the_layout(fx1):
    cfg = TrainConfig(method="sgd", penalty="l2", reg=0.1, iters=3, fraction=0.5, tol=0.0, sampler="bernoulli")
    table = fx1.repartition(4).cache()
    a, b = fit(table, cfg), fit(table, cfg)
    assert np.array_equal(a.weights, b.weights)  # same layout, same seeds 42 + i: same batches
    assert all(0 < h.batch_rows < 500 for h in a.history)


def test_advisory_warnings():
    with pytest.warns(UserWarning, match="convergence tolerance"):
        TrainConfig(fraction=0.5, tol=1e-3)
    with pytest.warns(UserWarning, match="not every row"):
        TrainConfig(iters=1, fraction=0.5, tol=0.0)


def test_multinomial_adam_matches_numpy(spark):
    from slopeline.sources import tables
    from conftest import SF_CHECK

    df = tables.embeddings_multiclass(spark, SF_CHECK)
    pdf = df.orderBy("key").toPandas()
    x = np.vstack(pdf.features.to_numpy()).astype(np.float64)
    y = pdf.label.to_numpy().astype(int)
    k, d = 9, 64
    onehot = (y[:, None] == np.arange(1, k + 1)[None, :]).astype(float)
    w, m, v = np.zeros(k * d), np.zeros(k * d), np.zeros(k * d)
    for t in range(3):
        z = x @ w.reshape(k, d).T
        shift = np.maximum(0, z.max(axis=1))
        e = np.exp(z - shift[:, None])
        p = e / (np.exp(-shift) + e.sum(axis=1))[:, None]
        g = ((p - onehot).T @ x).ravel() / len(y) + 0.1 * w
        v = 0.99 * v + 0.01 * g * g
        m = 0.9 * m + 0.1 * g
        w = w - 0.01 * (m / (1 - 0.9 ** (t + 1))) / (np.sqrt(v / (1 - 0.99 ** (t + 1))) + 1e-8)
    res = fit(df, TrainConfig(loss="multinomial", num_classes=10, method="adam", penalty="l2", reg=0.1, step=0.01,
                              iters=3, tol=0.0))
    assert np.allclose(res.weights, w, atol=1e-12)
    assert res.model.num_classes == 10 and len(res.model.weights) == k * d


def test_wide_rejects_bad_labels(spark):
    from slopeline.operators.wide import fit_wide

    entries = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0)], "key BIGINT, idx INT, value DOUBLE")
    labels = spark.createDataFrame([(1, 2.0), (2, 0.0)], "key BIGINT, label DOUBLE")
    with pytest.raises(ValueError, match="labels are not"):
        fit_wide(entries, labels, TrainConfig(iters=1))


def test_wide_rejects_null_entries(spark):
    from slopeline.operators.wide import fit_wide

    entries = spark.createDataFrame([(1, 0, None), (2, 1, 1.0)], "key BIGINT, idx INT, value DOUBLE")
    labels = spark.createDataFrame([(1, 1.0), (2, 0.0)], "key BIGINT, label DOUBLE")
    with pytest.raises(ValueError, match="null index or value"):
        fit_wide(entries, labels, TrainConfig(iters=1))


def test_predict_wide_equals_dense_scoring(spark, fx1):
    from slopeline.operators.scoring import predict
    from slopeline.operators.wide import predict_wide
    from slopeline.sources.models import LinearModel

    w = np.linspace(-0.2, 0.2, 64)
    entries = fx1.select("key", F.posexplode("features").alias("idx", "value"))
    wdf = spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "idx INT, weight DOUBLE")
    got = {r["key"]: r["prediction"] for r in predict_wide(entries, wdf, keys=fx1, num_features=64).collect()}
    want = {r["key"]: r["prediction"] for r in predict(fx1, LinearModel(w)).collect()}
    assert got == want


def test_md5_draws_match_python(spark):
    import hashlib

    from slopeline.functions.sampling import uniform

    df = spark.createDataFrame([(k, k * 7 + 3) for k in range(50)], "key BIGINT, _rid BIGINT")
    got = {r["key"]: (r["u"], r["s"]) for r in df.select("key", uniform("key", 43, "md5").alias("u"),
                                                          uniform("key", 43, "md5", "_rid").alias("s")).collect()}
    for k in range(50):
        plain = int(hashlib.md5(f"{k}:43".encode()).hexdigest()[:8], 16) / 2 ** 32
        salted = int(hashlib.md5(f"{k}:{k * 7 + 3}:43".encode()).hexdigest()[:8], 16) / 2 ** 32
        assert got[k] == (plain, salted)


def _long(fx):
    from pyspark.sql import functions as F

    return fx.select("key", F.posexplode("features").alias("idx", "value")).where("value <> 0")


def test_wide_iterations_do_not_slow_down_or_leak(spark, fx1):
    import time

    from slopeline.operators.wide import fit_wide

    entries, labels = _long(fx1).cache(), fx1.select("key", "label").cache()
    entries.count(), labels.count()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    kw = dict(method="adam", penalty="l2", reg=0.1, step=0.01, tol=0.0)
    fit_wide(entries, labels, TrainConfig(iters=2, **kw), num_features=64)  # warm
    times = {}
    for n in (4, 20):
        t = time.perf_counter()
        res = fit_wide(entries, labels, TrainConfig(iters=n, **kw), num_features=64)
        times[n] = time.perf_counter() - t
        assert res.updates == n
        assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    # iterations 5 to 20 take no longer each than the first four (set-up included in those)
    assert (times[20] - times[4]) / 16 < 1.2 * times[4] / 4
    assert "idx" in res.weights.columns and res.weights.count() == 64
    entries.unpersist(), labels.unpersist()


def test_wide_rejects_an_index_beyond_num_features(spark, fx1):
    from slopeline.operators.wide import fit_wide

    with pytest.raises(ValueError, match="beyond num_features"):
        fit_wide(_long(fx1), fx1.select("key", "label"), TrainConfig(iters=1), num_features=32)


def test_wide_warm_start_equals_a_longer_run_of_plain_steps(spark, fx1):
    from slopeline.operators.wide import fit_wide

    kw = dict(method="sgd", penalty="none", step=0.5, tol=0.0)
    first = fit_wide(_long(fx1), fx1.select("key", "label"), TrainConfig(iters=1, **kw), num_features=64)
    again = fit_wide(_long(fx1), fx1.select("key", "label"), TrainConfig(iters=1, **kw), num_features=64, initial_weights=first.weights)
    dense = fit(fx1, TrainConfig(iters=1, **kw), initial_weights=np.array([r["weight"] for r in first.weights.orderBy("idx").collect()]))
    got = np.array([r["weight"] for r in again.weights.orderBy("idx").collect()])
    np.testing.assert_allclose(got, dense.weights, rtol=1e-9, atol=1e-12)


def test_predict_wide_keeps_keys_whose_entries_have_no_weight(spark):
    from slopeline.operators.wide import predict_wide

    entries = spark.createDataFrame([(1, 0, 2.0), (2, 9, 5.0)], "key long, idx int, value double")
    weights = spark.createDataFrame([(0, 1.0)], "idx int, weight double")
    keys = spark.createDataFrame([(3,), (1,)], "key long")
    out = {r["key"]: r["prediction"] for r in predict_wide(entries, weights, keys=keys, threshold=None).collect()}
    assert out[2] == 0.5 and out[3] == 0.5 and out[1] > 0.8
    with pytest.raises(ValueError, match="larger than num_features"):
        predict_wide(entries, spark.createDataFrame([(7, 1.0)], "idx int, weight double"), num_features=3)


def test_null_keys_are_drawn_too(spark):
    from slopeline.functions.sampling import keyed_sample, keyed_split

    df = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (2, 4)], "key long, v int")
    for sampler in ("md5", "xxhash64"):
        parts = keyed_split(df, "key", sampler=sampler)
        assert sum(p.count() for p in parts) == 4
        assert keyed_sample(df, "key", 0.999999, 1, sampler).count() == 4
    spread = keyed_split(spark.range(1000).selectExpr("1 AS key", "id AS v"), "key", salt="v")
    assert 600 < spread[0].count() < 800  # one key, split by row


def test_auc_rejects_rows_without_label_or_score(spark):
    from pyspark.errors import PySparkException

    from slopeline.operators.metrics import area_under_roc

    for row in ((None, 0.4), (1.0, None)):
        with pytest.raises(PySparkException, match="a row has no"):
            area_under_roc(spark.createDataFrame([(1.0, 0.5), (0.0, 0.1), row], "label double, score double"))


@pytest.mark.parametrize("width", [3, 300])
def test_scoring_rejects_wrong_vectors_alike(spark, width):
    from pyspark.errors import PySparkException

    from slopeline.operators.scoring import predict
    from slopeline.sources.models import LinearModel

    model = LinearModel(np.linspace(-1, 1, width))
    good = [1.0] * width
    assert predict(spark.createDataFrame([(good,)], "features array<double>"), model).count() == 1
    for bad in (good + [1.0], good[:-1], good[:-1] + [None], None):
        with pytest.raises(PySparkException, match="length|null"):
            predict(spark.createDataFrame([(bad,)], "features array<double>"), model).collect()


def test_model_kinds_predict_by_their_loss(spark):
    from slopeline.functions.losses import MultinomialLoss
    from slopeline.operators.scoring import predict
    from slopeline.session import scratch_path
    from slopeline.sources.models import load_model, save_model

    rows = [(k, float(k % 2), [1.0, (k % 2) * 2.0 - 1.0 + 0.01 * k]) for k in range(40)]
    df = spark.createDataFrame(rows, "key long, label double, features array<double>")
    reg = fit(df, TrainConfig(loss="least_squares", penalty="none", step=0.5, iters=40, tol=0.0)).model
    hinge = fit(df, TrainConfig(loss="hinge", penalty="none", step=0.5, iters=40, tol=0.0)).model
    assert (reg.kind, reg.threshold, hinge.kind, hinge.threshold) == ("least_squares", None, "hinge", 0.0)
    out = {r["key"]: r["prediction"] for r in predict(df, reg).collect()}
    assert len(set(out.values())) > 10 and all(abs(out[k] - k % 2) < 0.5 for k in out)
    assert all(r["prediction"] == r["label"] for r in predict(df, hinge).collect())
    path = scratch_path(spark, "hinge-model")
    save_model(spark, hinge, path)
    assert load_model(spark, path).kind == "hinge"
    two = fit(df, TrainConfig(loss="multinomial", num_classes=2, intercept=True, iters=3, tol=0.0)).model
    assert (two.num_features, two.num_classes, len(two.weights)) == (2, 2, 2)
    three = fit(df, TrainConfig(loss=MultinomialLoss(3), intercept=True, iters=3, tol=0.0)).model
    assert (three.kind, three.num_classes, three.num_features) == ("multinomial", 3, 2)


def _sparse(spark, rows):
    return spark.createDataFrame(rows, "key long, label double, features struct<indices:array<int>,values:array<double>>")


SPARSE_ROWS = [(1, 1.0, ([0, 3], [1.0, 2.0])), (2, 0.0, ([], [])), (3, 0.0, ([2], [-1.5])), (4, 1.0, ([1, 2, 3], [0.5, 0.5, 0.5]))]


def _dense_of(spark, d=4):
    rows = []
    for k, y, (i, v) in SPARSE_ROWS:
        x = [0.0] * d
        for a, b in zip(i, v):
            x[a] = b
        rows.append((k, y, x))
    return spark.createDataFrame(rows, "key long, label double, features array<double>")


@pytest.mark.parametrize("kw", [dict(method="sgd"), dict(method="adam", step=0.1), dict(method="sgd", intercept=True, penalise_bias=False),
                                dict(loss="multinomial", num_classes=3), dict(method="svrg", step=0.1, order="key", shard_by="key_mod", shards=2)])
def test_sparse_features_train_like_dense_ones(spark, kw):
    from slopeline.operators.scoring import predict

    cfg = TrainConfig(**{**dict(penalty="l2", reg=0.1, iters=4, tol=0.0), **kw})
    sparse, dense = _sparse(spark, SPARSE_ROWS), _dense_of(spark)
    a, b = fit(sparse, cfg, num_features=4), fit(dense, cfg)
    np.testing.assert_allclose(a.weights, b.weights, rtol=1e-12, atol=1e-14)
    got = {r["key"]: r["prediction"] for r in predict(sparse, a.model).collect()}
    assert got == {r["key"]: r["prediction"] for r in predict(dense, b.model).collect()}


def test_sparse_input_is_checked(spark):
    for bad, why in (([(1, 1.0, ([5], [1.0]))], "beyond num_features"), ([(1, 1.0, ([-1], [1.0]))], "must lie in"),
                     ([(1, 1.0, ([0, 1], [1.0]))], "more indices"), ([(1, 1.0, None)], "null feature"), ([(1, 1.0, ([0], [None]))], "null feature")):
        with pytest.raises(ValueError, match=why):
            fit(_sparse(spark, bad), TrainConfig(iters=1), num_features=3)


def test_libsvm_reads_sparse_and_feeds_wide_mode(spark, fx1):
    from slopeline.operators.wide import fit_wide
    from slopeline.session import scratch_path
    from slopeline.sources.libsvm import entries_of, read_libsvm, write_libsvm

    path = scratch_path(spark, "sparse")
    write_libsvm(fx1, path)
    df = read_libsvm(spark, path, num_features=64, with_key=True, sparse=True)
    assert dict(df.dtypes)["features"] == "struct<indices:array<int>,values:array<double>>"
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "vector_to_array" not in plan
    cfg = TrainConfig(method="sgd", penalty="l2", reg=0.1, iters=3, tol=0.0)
    wide = fit_wide(entries_of(df), df.select("key", "label"), cfg, num_features=64)
    got = np.array([r["weight"] for r in wide.weights.orderBy("idx").collect()])
    np.testing.assert_allclose(got, fit(df, cfg, num_features=64).weights, rtol=1e-9, atol=1e-12)


def test_row_ids_do_not_depend_on_the_layout(spark):
    from slopeline.operators.trainers import prepare

    rows = [(1, 1.0, [1.0, 2.0])] * 5 + [(k, 0.0, [float(k), 1.0]) for k in range(6)]
    df = spark.createDataFrame(rows, "key long, label double, features array<double>")
    ids = [sorted(r["_rid"] for r in prepare(d, row_ids=True).collect()) for d in (df, df.repartition(7), df.orderBy("label"))]
    assert ids[0] == ids[1] == ids[2] and len(set(ids[0])) == len(rows)


def test_shards_too_large_for_their_bound_are_streamed(spark, fx1):
    cfg = TrainConfig(method="svrg", iters=1, shards=2, step=0.1, tol=0.0)
    np.testing.assert_allclose(fit(fx1, cfg, max_shard_bytes=1000).weights, fit(fx1, cfg).weights, rtol=1e-9, atol=1e-12)


def test_empty_mean_sample_skips_the_iteration(spark, fx1):
    with pytest.warns(UserWarning, match="mean gradient is empty"):
        res = fit(fx1, TrainConfig(method="svrg_avg", iters=2, tol=0.0, mean_fraction=1e-9, step=0.1))
    assert res.updates == 0 and not res.weights.any()


def test_bernoulli_batch_is_a_plain_subset_of_plausible_size(spark, fx1):
    from slopeline.functions.sampling import keyed_sample

    keys = [r["key"] for r in keyed_sample(fx1, "key", 0.3, 43, "bernoulli").select("key").collect()]
    every, n = {r["key"] for r in fx1.select("key").collect()}, fx1.count()
    assert set(keys) <= every and len(set(keys)) == len(keys)
    assert abs(len(keys) - 0.3 * n) < 5 * (n * 0.3 * 0.7) ** 0.5
