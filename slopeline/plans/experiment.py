"""The training experiment: binarise labels, split 70/30 by key, train each method on the
training part, score the held-out part and report the area under the ROC curve, row
counts and elapsed time -- one report row per method."""

from __future__ import annotations

import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeline.functions.labels import binarize
from slopeline.functions.sampling import SPLIT_SEED, keyed_split
from slopeline.operators.metrics import area_under_roc
from slopeline.operators.gradient import is_sparse
from slopeline.operators.scoring import as_arrays, score_column
from slopeline.operators.trainers import TrainConfig, fit, prepare, prepared

# Fixed values of the experiment: regularisation weight 1 and the step of each method.
EXPERIMENT_REG = 1.0
EXPERIMENT_STEPS = {"sgd": 1.0, "momentum": 1.0, "svrg_avg": 1.0, "adadelta": 1.0, "adagrad": 0.01, "adam": 0.001}
EXPERIMENT_METHODS = ("momentum", "sgd", "svrg_avg", "adagrad", "adadelta", "adam")

REPORT_SCHEMA = ("method STRING, auc DOUBLE, train_rows BIGINT, test_rows BIGINT, rows BIGINT, "
                 "iterations INT, elapsed_ms DOUBLE")


def run_experiment(df: DataFrame, *, methods=EXPERIMENT_METHODS, iterations: int = 100, fraction: float = 1.0,
                   mean_fraction: float = 1.0, tol: float = 1e-7, partitions: int | None = None,
                   variant: str = "published", sampler: str = "xxhash64", key: str = "key", label: str = "label",
                   features: str = "features", trainer_options: dict | None = None,
                   split_by: str = "row", split_salt: str | None = None) -> DataFrame:
    """Report ``(method, auc, train_rows, test_rows, rows, iterations, elapsed_ms)``.

    ``sampler`` hashes keys for the split and the mini-batches (``md5`` reproduces them in
    other SQL engines). The split is by row: rows are numbered among their equals, or told apart by the
    column ``split_salt`` if there is one, so that a key that many rows share lies in both parts.
    ``split_by="key"`` keeps the rows of a key together. The training part is prepared once (numbered,
    checked, cached, sharded) and every method trains on it. ``trainer_options`` adds
    ``TrainConfig`` fields (e.g. SVRG shards)."""
    if split_by not in ("row", "key"):
        raise ValueError("split_by must be 'row' or 'key'")
    spark = df.sparkSession
    configs = [TrainConfig(method=method, penalty="l2", reg=EXPERIMENT_REG, step=EXPERIMENT_STEPS[method],
                           iters=iterations, fraction=fraction, mean_fraction=mean_fraction, tol=tol,
                           variant=variant, sampler=sampler, **(trainer_options or {})) for method in methods]
    data = df.select(F.col(key).alias("key"), binarize(label).alias("label"), F.col(features).alias("features"),
                     *([F.col(split_salt).alias("_salt")] if split_salt else []))
    if partitions:
        data = data.repartition(int(partitions))
    salt = "_salt" if split_salt else None
    if split_by == "row" and not salt:
        data, salt = prepare(data, row_ids=True), "_rid"
    train, test = keyed_split(data, "key", (0.7, 0.3), seed=SPLIT_SEED, sampler=sampler, salt=salt)
    rows, fits = [], []
    with prepared(train, configs[0], row_ids=any(c.needs_row_ids() for c in configs)) as ready:
        train_rows = ready.facts.rows
        for cfg in configs:
            started = time.perf_counter()
            fits.append((cfg.method, fit(ready, cfg), started, time.perf_counter()))
    # the held-out part is read once: every model's score of a row, side by side
    scoring_started = time.perf_counter()
    scores = as_arrays(test).select("label", *(score_column(res.model.clear_threshold(), sparse=is_sparse(test)).alias(f"s{k}") for k, (_, res, _, _) in enumerate(fits)))
    scores = scores.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        test_rows = scores.count()
        each = (time.perf_counter() - scoring_started) / max(1, len(fits))
        for k, (method, res, started, ended) in enumerate(fits):
            at = time.perf_counter()
            auc = area_under_roc(scores.select("label", F.col(f"s{k}").alias("score")))
            # the keyed split is disjoint and complete, so the row count needs no further scan;
            # elapsed: training, this method's AUC and its share of the scoring pass
            elapsed = (ended - started) + each + (time.perf_counter() - at)
            rows.append((method, auc, train_rows, test_rows, train_rows + test_rows, res.iterations, elapsed * 1000.0))
    finally:
        scores.unpersist()
    return spark.createDataFrame(rows, REPORT_SCHEMA)


# The algorithm names of the command line and the trainers they run.
CLI_METHODS = {"momentum": "momentum", "sgd": "sgd", "svrg": "svrg_avg", "adagrad": "adagrad",
               "adadelta": "adadelta", "adam": "adam"}


def main(argv=None) -> int:
    """``python -m slopeline.plans.experiment ITERATIONS PATH PARTITIONS ALGORITHM MEAN_FRACTION
    FRACTION TOL`` -- the experiment over a LIBSVM file, printing the report."""
    import argparse

    from slopeline.session import ensure_checkpoint_dir
    from slopeline.sources.libsvm import read_libsvm
    from pyspark.sql import SparkSession

    ap = argparse.ArgumentParser(prog="slopeline.plans.experiment")
    ap.add_argument("iterations", type=int)
    ap.add_argument("path")
    ap.add_argument("partitions", type=int)
    ap.add_argument("algorithm", choices=sorted(CLI_METHODS))
    ap.add_argument("mean_fraction", type=float)
    ap.add_argument("fraction", type=float)
    ap.add_argument("tol", type=float)
    ap.add_argument("--variant", choices=("published", "observed"), default="published")
    ap.add_argument("--num-features", type=int, default=None)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName("slopeline-experiment").getOrCreate()
    ensure_checkpoint_dir(spark)
    data = read_libsvm(spark, args.path, args.num_features, with_key=True, partitions=args.partitions, sparse=True)
    report = run_experiment(data, methods=(CLI_METHODS[args.algorithm],), iterations=args.iterations,
                            fraction=args.fraction, mean_fraction=args.mean_fraction, tol=args.tol,
                            variant=args.variant)
    for row in report.collect():
        print(row.asDict())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
