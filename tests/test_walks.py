"""Lazy and streamed walks, wide mode's new parts, prepared tables and spread row numbers."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeline import PreparedTable, TrainConfig, UpdateRule, fit, fit_wide, predict_wide, prepared
from slopeline.functions.losses import LogisticLoss, MultinomialLoss
from slopeline.operators import lazy_walks, trainers
from slopeline.operators.gradient import SparseRows
from slopeline.operators.svrg import draw
from slopeline.session import scratch_path
from slopeline.sources.models import load_wide_model, save_wide_model, wide_model

SCHEMA = "key long, label double, features struct<indices:array<int>,values:array<double>>"


def sparse_rows(n=60, d=40, seed=3, classes=2):
    rnd = np.random.default_rng(seed)
    out = []
    for k in range(n):
        idx = sorted(rnd.choice(d, size=int(rnd.integers(0, 6)), replace=False).tolist())
        out.append((k, float(rnd.integers(0, classes)), (idx, rnd.normal(size=len(idx)).tolist())))
    return out


def dense_rows(rows, d=40):
    out = []
    for k, y, (idx, val) in rows:
        x = np.zeros(d)
        np.add.at(x, idx, val)
        out.append((k, y, x.tolist()))
    return out


def both(spark, rows, d=40):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(dense_rows(rows, d), "key long, label double, features array<double>")


@pytest.mark.parametrize("rate", [0.0, 1e-9, 0.03, 0.9, 1.0, 1.7])
def test_idle_steps_in_closed_form(rate):
    kept, sums, a, s = 1.0, 0.0, 1.0 - rate, 0.0
    for m in range(60):
        got = lazy_walks.decay(m, rate)
        np.testing.assert_allclose(got, (kept, sums), rtol=1e-9, atol=1e-12)
        sums, kept = sums + kept, kept * a
    vector = lazy_walks.decay(np.array([0, 3, 7]), np.array([rate, 0.0, rate]))
    np.testing.assert_allclose(vector[1][1], 3)


@pytest.mark.parametrize("outputs", [1, 2])
def test_a_lazy_walk_equals_the_plain_one(outputs):
    import pyarrow as pa

    rnd = np.random.default_rng(1)
    rows = sparse_rows(50, 30, classes=outputs + 1)
    table = pa.array([{"indices": i, "values": v} for _, _, (i, v) in rows], pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))
    x = np.array([r[2] for r in dense_rows(rows, 30)])
    y = np.array([r[1] for r in rows])
    loss = LogisticLoss() if outputs == 1 else MultinomialLoss(3)
    w, mu, eta, reg = rnd.normal(size=(outputs, 30)), rnd.normal(size=(outputs, 30)), 0.2, 0.3
    order = rnd.integers(0, 50, size=200)
    _, mult0 = loss.numpy(x @ w.T, y)
    plain, total = w.copy(), np.zeros_like(w)
    for r in order:
        _, m = loss.numpy((plain @ x[r])[None], y[r : r + 1])
        push = np.outer(m[0] - mult0[r], x[r])
        total += push
        plain = (1 - eta * reg) * plain - eta * (push + mu)
    state, lazy_total = lazy_walks.LazyWeights(w, mu, eta, eta * reg), np.zeros_like(w)
    steps = lazy_walks.WalkRows(SparseRows(table, 30))
    lazy_walks.walk(steps, y, mult0, order, state, loss, lazy_total)
    np.testing.assert_allclose(state.finish(), plain, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(lazy_total, total, rtol=1e-9, atol=1e-9)


def test_the_cost_of_a_step_is_its_entries():
    """Ten times the features, the same entries: no more time."""
    import pyarrow as pa

    kind = pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    times = {}
    for d in (200_000, 2_000_000):
        rnd = np.random.default_rng(2)
        rows = SparseRows(pa.array([{"indices": rnd.choice(d, 5, False).tolist(), "values": [1.0] * 5} for _ in range(20)], kind), d)
        state = lazy_walks.LazyWeights(np.zeros((1, d)), np.ones((1, d)), 0.1, 0.01)
        steps, y = lazy_walks.WalkRows(rows), np.zeros(20)
        began = time.process_time()
        lazy_walks.walk(steps, y, np.zeros((20, 1)), np.arange(3000) % 20, state, LogisticLoss())
        times[d] = time.process_time() - began
    assert times[2_000_000] < 3 * times[200_000] + 0.2


KINDS = [dict(method="svrg"), dict(method="svrg_avg", mean_fraction=0.6, variant="observed"), dict(method="svrg_avg", order="key", penalty="none"),
         dict(method="svrg_avg", intercept=True, penalise_bias=False), dict(method="svrg", order="key", intercept=True, penalise_bias=False), dict(method="svrg_avg", loss="multinomial", num_classes=3)]


@pytest.mark.parametrize("kw", KINDS)
def test_sparse_streamed_and_wide_walks_equal_dense_ones(spark, kw):
    rows = sparse_rows(classes=kw.get("num_classes", 2))
    sparse, dense = both(spark, rows)
    cfg = TrainConfig(**{**dict(penalty="l2", reg=0.2, step=0.3, iters=2, tol=0.0, shards=3, shard_by="key_mod", fraction=0.8, sampler="md5", sample_by="key"), **kw})
    want = fit(dense, cfg)
    for other in (fit(sparse, cfg, num_features=40), fit(dense, cfg, max_shard_bytes=1), fit(sparse, cfg, num_features=40, max_shard_bytes=1)):
        np.testing.assert_allclose(other.weights, want.weights, rtol=1e-9, atol=1e-11)
        np.testing.assert_allclose(other.loss_history, want.loss_history, rtol=1e-9)
    entries = sparse.select("key", F.explode(F.arrays_zip("features.indices", "features.values")).alias("e")).select("key", F.col("e.indices").alias("idx"), F.col("e.values").alias("value"))
    wide = fit_wide(entries, sparse.select("key", "label"), cfg, num_features=40)
    order = ["class", "idx"] if "class" in wide.weights.columns else ["idx"]
    got = np.array([r["weight"] for r in wide.weights.orderBy(*order).collect()])
    block = want.weights.reshape(-1, 41 if cfg.intercept else 40)
    np.testing.assert_allclose(got.reshape(-1, 40), block[:, :40], rtol=1e-9, atol=1e-11)
    if cfg.intercept:
        np.testing.assert_allclose(wide.intercepts, block[:, 40], rtol=1e-9, atol=1e-11)
    np.testing.assert_allclose([h.loss for h in wide.history], [h.loss for h in want.history], rtol=1e-9)


def test_draws_as_columns_are_the_draws(spark):
    rows = spark.createDataFrame([(k, 0.0, [1.0], k % 2) for k in range(20)], "key long, label double, features array<double>, shard int")
    got = {(r["shard"], r["place"]): r["draw"] for r in lazy_walks.drawn(rows, 3, 42).collect()}
    assert got == {(s, p): draw(3, s, p, 42) for s in (0, 1) for p in range(10)}


def test_a_shard_ten_times_its_bound_is_streamed_and_never_held(spark):
    n, d = 4000, 20
    rnd = np.random.default_rng(5)
    rows = [(k, float(k % 2), rnd.normal(size=d).tolist()) for k in range(n)]
    df = spark.createDataFrame(rows, "key long, label double, features array<double>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        cfg = TrainConfig(method="svrg_avg", reg=0.1, step=0.05, iters=2, tol=0.0, shards=1, shard_by="key_mod")
        streamed = fit(df, cfg, max_shard_bytes=n * d * 8 // 10)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    np.testing.assert_allclose(streamed.weights, fit(df, cfg).weights, rtol=1e-9, atol=1e-11)


def momentum_like(w, g, state, ctx, ops):
    v = 0.5 * state["v"] + g
    return w - ctx.eta * v - 0.01 * ops.sign(w) * ops.sqrt(ops.abs(w)), {"v": v}


WIDE = [dict(method="adam", step=0.05), dict(method="sgd", intercept=True, penalise_bias=False), dict(method="momentum", intercept=True),
        dict(loss="multinomial", num_classes=4, method="adagrad", step=0.2, intercept=True, penalise_bias=False), dict(penalty="l1", intercept=True),
        dict(update=UpdateRule(momentum_like, ("v",)), penalty="none")]


@pytest.mark.parametrize("kw", WIDE)
def test_wide_equals_dense(spark, kw):
    rows = sparse_rows(classes=kw.get("num_classes", 2))
    sparse, _ = both(spark, rows)
    cfg = TrainConfig(**{**dict(method="sgd", penalty="l2", reg=0.2, step=0.5, iters=3, tol=0.0, fraction=0.7, sampler="md5", sample_by="key"), **kw})
    want = fit(sparse, cfg, num_features=40)
    entries = sparse.select("key", F.explode(F.arrays_zip("features.indices", "features.values")).alias("e")).select("key", F.col("e.indices").alias("idx"), F.col("e.values").alias("value"))
    wide = fit_wide(entries, sparse.select("key", "label"), cfg, num_features=40)
    order = ["class", "idx"] if "class" in wide.weights.columns else ["idx"]
    got = np.array([r["weight"] for r in wide.weights.orderBy(*order).collect()]).reshape(-1, 40)
    block = want.weights.reshape(-1, 41 if cfg.intercept else 40)
    np.testing.assert_allclose(got, block[:, :40], rtol=1e-9, atol=1e-11)
    np.testing.assert_allclose(wide.intercepts, block[:, 40:].ravel(), rtol=1e-9, atol=1e-11)
    np.testing.assert_allclose(wide.loss_history, want.loss_history, rtol=1e-9)
    from slopeline.operators.scoring import predict

    mine = {r["key"]: r["prediction"] for r in predict_wide(entries, wide.weights, keys=sparse.select("key"), intercept=wide.intercepts or 0.0, num_features=40).collect()}
    assert mine == {r["key"]: r["prediction"] for r in predict(sparse, want.model, keep=["key"]).collect()}


def test_plain_functions_are_no_wide_rule(spark):
    entries = spark.createDataFrame([(1, 0, 1.0)], "key long, idx int, value double")
    labels = spark.createDataFrame([(1, 1.0)], "key long, label double")
    with pytest.raises(ValueError, match="UpdateRule"):
        fit_wide(entries, labels, TrainConfig(iters=1, update=lambda w, g, s, c: (w, s)))
    with pytest.raises(ValueError, match="returns state"):
        fit_wide(entries, labels, TrainConfig(iters=1, update=UpdateRule(lambda w, g, s, c, ops: (w, {"x": g}), ("v",))))


def test_wide_models_are_committed_by_their_manifest(spark):
    rows = sparse_rows()
    sparse, _ = both(spark, rows)
    entries = sparse.select("key", F.explode(F.arrays_zip("features.indices", "features.values")).alias("e")).select("key", F.col("e.indices").alias("idx"), F.col("e.values").alias("value"))
    res = fit_wide(entries, sparse.select("key", "label"), TrainConfig(iters=2, tol=0.0, intercept=True), num_features=40)
    path = save_wide_model(wide_model(res), scratch_path(spark, "wide"))
    back = load_wide_model(spark, path)
    assert (back.intercepts, back.num_features, back.threshold, back.kind) == (res.intercepts, 40, 0.5, "logistic")
    assert sorted(map(tuple, back.weights.collect())) == sorted(map(tuple, res.weights.collect()))
    assert back.predict(entries, keys=sparse.select("key")).count() == len(rows)
    torn = scratch_path(spark, "torn")
    res.weights.write.parquet(f"{torn}/weights")
    with pytest.raises(ValueError, match="manifest is missing"):
        load_wide_model(spark, torn)
    res.weights.limit(1).write.mode("append").parquet(f"{path}/weights")
    with pytest.raises(ValueError, match="not those of its manifest"):
        load_wide_model(spark, path)


def test_copies_of_a_row_are_spread_before_they_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(trainers, "UNFOLD_ROWS", 1000)
    same = spark.range(200_000).selectExpr("1L as key", "1.0D as label", "array(1.0D, 2.0D) as features")
    few = spark.createDataFrame([(k, 0.0, [float(k), 0.0]) for k in range(50)], "key long, label double, features array<double>")
    out = trainers.prepare(same.unionByName(few), row_ids=True)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 200_050 and max(sizes) < 60_000 and len(sizes) >= 8
    assert out.select("_rid").distinct().count() == 200_050


def test_a_prepared_table_trains_every_method_as_a_plain_one(spark, fx1):
    configs = [TrainConfig(method=m, reg=0.1, step=0.1, iters=2, tol=0.0, shards=4, fraction=0.5) for m in ("sgd", "adam", "svrg", "svrg_avg")]
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    with prepared(fx1, configs[2]) as ready:
        assert isinstance(ready, PreparedTable) and ready.facts.dim == 64
        mine = [fit(ready, c).weights for c in configs]
        assert len(ready.sharded) == 1
        with pytest.raises(ValueError, match="another intercept"):
            fit(ready, configs[0], intercept=True)
        with pytest.raises(ValueError, match="labels are not"):
            fit(prepared(fx1.withColumn("label", F.lit(3.0)), loss="least_squares"), loss="hinge", iters=1)
    for c, w in zip(configs, mine):
        np.testing.assert_allclose(w, fit(fx1, c).weights, rtol=1e-9, atol=1e-12)
    spark.catalog.clearCache()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_the_jvm_kernel_compiles_the_same_code_at_every_step(spark):
    from slopeline.functions.losses import resolve_loss
    from slopeline.operators.gradient import gradient_row_sums

    df = spark.createDataFrame([(1.0, [1.0, 2.0])], "label double, features array<double>")
    plans = [gradient_row_sums(df, np.array(w), resolve_loss("logistic"), 2)._jdf.queryExecution().executedPlan().toString() for w in ([0.1, 0.2], [0.3, -0.4])]
    assert all("0.1" not in p and "0.3" not in p for p in plans) and all("BroadcastNestedLoopJoin" in p for p in plans)
