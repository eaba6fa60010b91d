"""AUC against Spark's evaluator and edge cases; model and LIBSVM round trips."""

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from slopeline.operators.metrics import area_under_roc, auc_frame
from slopeline.operators.scoring import predict, score_and_label
from slopeline.operators.trainers import TrainConfig, fit
from slopeline.session import scratch_path
from slopeline.sources import libsvm, models


def test_auc_matches_evaluator_and_buckets(spark, fx1):
    res = fit(fx1, TrainConfig(method="sgd", penalty="l2", reg=1.0, iters=3, tol=0.0))
    pairs = score_and_label(fx1, res.model)
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    want = ev.evaluate(pairs)
    assert area_under_roc(pairs) == pytest.approx(want, abs=1e-12)
    bucketed = auc_frame(pairs, bucket_rows=37).collect()[0]["auc"]
    assert bucketed == pytest.approx(want, abs=1e-12)


def test_auc_ties_constant_and_single_class(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.5, 0.0), (0.9, 1.0), (0.1, 0.0)], "score DOUBLE, label DOUBLE")
    assert area_under_roc(df) == pytest.approx((1 * (1 + 0.5 * 1) + 1 * 2) / 4)
    const = spark.createDataFrame([(0.3, float(i % 2)) for i in range(10)], "score DOUBLE, label DOUBLE")
    assert area_under_roc(const) == pytest.approx(0.5)
    one = spark.createDataFrame([(0.3, 1.0), (0.4, 1.0)], "score DOUBLE, label DOUBLE")
    assert area_under_roc(one) is None


def test_threshold_is_strict_and_clearable(spark):
    m = models.LinearModel(np.array([0.0, 0.0]))
    df = spark.createDataFrame([(1, [1.0, 2.0])], "key BIGINT, features ARRAY<DOUBLE>")
    assert predict(df, m).collect()[0]["prediction"] == 0.0  # score 0.5 is not > 0.5
    assert predict(df, m.clear_threshold()).collect()[0]["prediction"] == 0.5


def test_multiclass_prediction_rules(spark):
    w = np.array([1.0, 0.0, 2.0, 0.0])  # class 1 margin = x0, class 2 margin = 2 x0; bias-free
    m = models.LinearModel(w, num_features=2, num_classes=3)
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 5.0])], "key BIGINT, features ARRAY<DOUBLE>")
    got = {r["key"]: r["prediction"] for r in predict(df, m).collect()}
    assert got == {1: 2.0, 2: 0.0, 3: 0.0}
    tie = models.LinearModel(np.array([1.0, 0.0, 1.0, 0.0]), num_features=2, num_classes=3)
    assert predict(df, tie).where("key = 1").collect()[0]["prediction"] == 1.0
    biased = models.LinearModel(np.array([0.0, 0.0, -5.0, 0.0, 0.0, 1.0]), num_features=2, num_classes=3)
    assert biased.has_bias_slot
    assert predict(df, biased).where("key = 3").collect()[0]["prediction"] == 2.0


def test_model_round_trip_and_format_check(spark):
    m = models.LinearModel(np.array([0.25, -1.5, 3.0]), intercept=0.5, threshold=None)
    path = scratch_path(spark, "model-test")
    models.save_model(spark, m, path)
    back = models.load_model(spark, path)
    assert np.array_equal(back.weights, m.weights) and back.intercept == 0.5 and back.threshold is None
    bad = scratch_path(spark, "model-bad")
    spark.read.parquet(path).withColumn("format", F.lit("other/9")).write.parquet(bad)
    with pytest.raises(ValueError, match="unrecognised"):
        models.load_model(spark, bad)


def test_model_shape_is_checked():
    with pytest.raises(ValueError):
        models.LinearModel(np.zeros(5), num_features=4, num_classes=2)
    with pytest.raises(ValueError):
        models.LinearModel(np.zeros(7), num_features=3, num_classes=3)


def test_libsvm_round_trip(spark, fx1):
    path = scratch_path(spark, "libsvm-test")
    libsvm.write_libsvm(fx1, path)
    back = libsvm.read_libsvm(spark, path, num_features=64)
    a = sorted((r["label"], tuple(float(v) for v in r["features"])) for r in fx1.collect())
    b = sorted((r["label"], tuple(r["features"])) for r in back.collect())
    assert a == b


def test_experiment_command_line(spark, fx1, capsys):
    from slopeline.plans.experiment import main

    path = scratch_path(spark, "libsvm-cli")
    libsvm.write_libsvm(fx1, path)
    assert main(["3", path, "4", "svrg", "1.0", "1.0", "0.0", "--num-features", "64"]) == 0
    out = capsys.readouterr().out
    assert "'method': 'svrg_avg'" in out and "'rows': 500" in out


def test_predict_point_matches_column_prediction(spark, fx1):
    res = fit(fx1, TrainConfig(method="sgd", penalty="l2", reg=1.0, iters=2, tol=0.0))
    rows = fx1.limit(20).collect()
    by_key = {r["key"]: r["prediction"] for r in predict(spark.createDataFrame(rows, fx1.schema), res.model).collect()}
    for r in rows:
        assert res.model.predict_point(r["features"]) == by_key[r["key"]]
    cleared = res.model.clear_threshold()
    scores = {r["key"]: r["prediction"] for r in predict(spark.createDataFrame(rows, fx1.schema), cleared).collect()}
    for r in rows:
        assert cleared.predict_point(r["features"]) == pytest.approx(scores[r["key"]], rel=1e-12)
    multi = models.LinearModel(np.array([1.0, 0.0, 2.0, 0.0]), num_features=2, num_classes=3)
    assert multi.predict_point([1.0, 0.0]) == 2.0 and multi.predict_point([-1.0, 0.0]) == 0.0


def test_scoring_accepts_vector_features(spark, fx1):
    from pyspark.ml.functions import array_to_vector

    m = models.LinearModel(np.linspace(-0.3, 0.3, 64))
    vec = fx1.select("key", "label", array_to_vector(F.col("features").cast("array<double>")).alias("features"))
    a = {r["key"]: r["prediction"] for r in predict(fx1, m).collect()}
    b = {r["key"]: r["prediction"] for r in predict(vec, m).collect()}
    assert a == b
