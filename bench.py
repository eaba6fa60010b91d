"""Headline timings at one scale factor; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
Per-iteration figures are ``(t(N iterations) - t(1 iteration)) / (N - 1)`` (each the best of
two runs) so the one-off validation/caching pass is excluded; ``mllib_*`` rows time ``pyspark.mllib``'s
``LogisticRegressionWithSGD`` on the same rows as the yardstick.
"""

from __future__ import annotations

import json
import os
import sys
import time
import warnings

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import StorageLevel  # noqa: E402

from slopeline.functions.losses import resolve_loss  # noqa: E402
from slopeline.operators.gradient import batch_sums  # noqa: E402
from slopeline.operators.metrics import area_under_roc  # noqa: E402
from slopeline.operators.scoring import score_and_label  # noqa: E402
from slopeline.operators.trainers import TrainConfig, fit, prepare  # noqa: E402
from slopeline.operators.wide import fit_wide  # noqa: E402
from slopeline.plans.experiment import run_experiment  # noqa: E402
from slopeline.session import local_session  # noqa: E402
from slopeline.sources import tables  # noqa: E402

warnings.filterwarnings("ignore")


def timed(fn, repeat: int = 1):
    """Best wall time of ``repeat`` runs and the last result."""
    best, out = float("inf"), None
    for _ in range(repeat):
        t = time.perf_counter()
        out = fn()
        best = min(best, time.perf_counter() - t)
    return best, out


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="slopeline-bench")
    q: dict[str, float] = {}

    fx2 = tables.lineitem_returns(spark, sf_dir)
    fx1 = tables.embeddings_binary(spark, sf_dir)
    fx3 = tables.embeddings_multiclass(spark, sf_dir)

    # one gradient pass over lineitem (A1): warm once, then the mean of three passes
    cached = prepare(fx2).repartition(spark.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    rows = cached.count()
    parts = cached.rdd.getNumPartitions()
    loss = resolve_loss("logistic")
    w = np.linspace(-0.1, 0.1, 5)
    batch_sums(cached, w, loss, 5, partitions=parts)
    q["gradient_pass_lineitem"] = float(np.mean([timed(lambda: batch_sums(cached, w, loss, 5, partitions=parts))[0]
                                                 for _ in range(3)]))

    def per_iter(df, n=10, **cfg):
        fit(df, TrainConfig(iters=1, tol=0.0, **cfg))  # warm-up
        t1, _ = timed(lambda: fit(df, TrainConfig(iters=1, tol=0.0, **cfg)), repeat=2)
        tn, res = timed(lambda: fit(df, TrainConfig(iters=n, tol=0.0, **cfg)), repeat=2)
        return tn, (tn - t1) / (n - 1), res

    total, it, res = per_iter(fx2, method="sgd", penalty="l2", reg=1.0, partitions=spark.sparkContext.defaultParallelism)
    q["sgd_lineitem_10it"] = total
    q["sgd_lineitem_per_iter"] = it
    t, _ = timed(lambda: area_under_roc(score_and_label(fx2, res.model)))
    q["score_auc_lineitem"] = t
    # the original experiment's end-to-end figure: split 70/30, train, score the held-out
    # part, AUC and a row count
    t, _ = timed(lambda: run_experiment(fx2, methods=("sgd",), iterations=10).collect())
    q["experiment_sgd_lineitem_10it"] = t

    # yardstick: pyspark.mllib SGD on the same cached rows
    from pyspark.mllib.classification import LogisticRegressionWithSGD
    from pyspark.mllib.regression import LabeledPoint

    rdd = cached.rdd.map(lambda r: LabeledPoint(r["label"], [float(v) for v in r["features"]])).persist()
    rdd.count()

    def mllib(n):
        return LogisticRegressionWithSGD.train(rdd, iterations=n, step=1.0, miniBatchFraction=1.0, regParam=1.0,
                                               regType="l2", intercept=False, convergenceTol=0.0)

    mllib(1)  # warm-up
    t1, _ = timed(lambda: mllib(1), repeat=2)
    t10, _ = timed(lambda: mllib(10), repeat=2)
    q["mllib_sgd_lineitem_10it"] = t10
    q["mllib_sgd_lineitem_per_iter"] = (t10 - t1) / 9
    rdd.unpersist()
    cached.unpersist()

    # ten copies of the lineitem fixture (6M rows at sf0.1): large partitions, where the
    # narrow model runs on the JVM kernel
    big = fx2
    for _ in range(9):
        big = big.unionByName(fx2)
    big = big.repartition(4 * spark.sparkContext.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
    big.count()
    total, it, _ = per_iter(big, n=6, method="sgd", penalty="l2", reg=1.0)
    q["sgd_lineitem_x10_6it"] = total
    q["sgd_lineitem_x10_per_iter"] = it
    big.unpersist()

    for method, step in (("momentum", 1.0), ("adagrad", 0.01), ("adadelta", 1.0), ("adam", 0.001)):
        total, it, _ = per_iter(fx1, method=method, penalty="l2", reg=1.0, step=step)
        q[f"{method}_embeddings_10it"] = total
        q[f"{method}_embeddings_per_iter"] = it
    q["sgd_minibatch_embeddings_10it"] = timed(
        lambda: fit(fx1, TrainConfig(method="sgd", penalty="l2", reg=1.0, iters=10, fraction=0.3, tol=0.0)))[0]
    q["svrg_embeddings_3it"] = timed(lambda: fit(fx1, TrainConfig(method="svrg", penalty="l2", reg=0.1, step=0.1,
                                                                   iters=3, tol=0.0, fraction=0.5)))[0]
    q["svrg_avg_embeddings_3it"] = timed(lambda: fit(fx1, TrainConfig(method="svrg_avg", penalty="l2", reg=0.1,
                                                                       step=0.1, iters=3, tol=0.0, fraction=0.5,
                                                                       mean_fraction=0.5)))[0]
    q["multinomial_embeddings_5it"] = timed(lambda: fit(fx3, TrainConfig(loss="multinomial", num_classes=10,
                                                                          method="sgd", penalty="l2", reg=0.1,
                                                                          iters=5, tol=0.0)))[0]
    for method, step in (("momentum", 1.0), ("adagrad", 0.01), ("adadelta", 1.0), ("adam", 0.001), ("svrg_avg", 0.1)):
        q[f"{method}_lineitem_5it"] = timed(lambda: fit(fx2, TrainConfig(method=method, penalty="l2", reg=1.0, step=step, iters=5, tol=0.0,
                                                                         partitions=spark.sparkContext.defaultParallelism)))[0]
    t, _ = timed(lambda: run_experiment(fx2, iterations=10, partitions=spark.sparkContext.defaultParallelism).collect())
    q["experiment_six_methods_lineitem_10it"] = t
    entries, labels = tables.embeddings_long(spark, sf_dir)
    q["sgd_wide_embeddings_20it"] = timed(lambda: fit_wide(entries, labels, TrainConfig(
        method="sgd", penalty="l2", reg=0.1, iters=20, tol=0.0), num_features=64).weights.count())[0]
    q["sgd_wide_embeddings_3it"] = timed(lambda: fit_wide(entries, labels, TrainConfig(
        method="sgd", penalty="l2", reg=0.1, iters=3, tol=0.0), num_features=64).weights.count())[0]

    q["svrg_avg_wide_embeddings_3it"] = timed(lambda: fit_wide(entries, labels, TrainConfig(
        method="svrg_avg", penalty="l2", reg=0.1, step=0.1, iters=3, tol=0.0, fraction=0.5, mean_fraction=0.5), num_features=64).weights.count())[0]

    headline = [k for k in q if not k.startswith("mllib_") and not k.endswith("_per_iter")]
    print(json.dumps({
        "metric": "total_sec_headline_queries",
        "value": round(sum(q[k] for k in headline), 3),
        "unit": "sec",
        "queries": {k: round(v, 4) for k, v in q.items()},
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "rows_lineitem": rows,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
