"""Evaluation and loss reports: exact area under the ROC curve, whole-table mean loss,
weight norms and per-row loss tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeline.functions.losses import MarginLoss
from slopeline.operators.gradient import staged_margins

# Distinct scores per range bucket of the exact AUC (one bucket is held by one task).
BUCKET_ROWS = 1_000_000


def score_counts(df: DataFrame, score: str = "score", label: str = "label", digits: int | None = None) -> DataFrame:
    """``(score, pos, neg)``: positives and negatives per distinct score (hash aggregate).
    A row without a label or a score is an error, not a negative."""
    s = F.when(F.col(score).isNull(), F.raise_error(F.lit("a row has no score"))).otherwise(F.col(score).cast("double"))
    if digits is not None:
        s = F.round(s, digits)
    y = F.when(F.col(label).isNull(), F.raise_error(F.lit("a row has no label"))).otherwise(F.col(label).cast("double"))
    return (df.select(s.alias("score"), y.alias("y"))
            .groupBy("score")
            .agg(F.sum(F.when(F.col("y") == 1.0, 1).otherwise(0)).cast("bigint").alias("pos"),
                 F.sum(F.when(F.col("y") == 1.0, 0).otherwise(1)).cast("bigint").alias("neg")))


def _range_area_kernel(batches):
    """Per range partition: sort the distinct scores, count negatives below each one inside
    the partition, and emit (lowest score, local area, positives, negatives)."""
    import pyarrow as pa

    tables = [b for b in batches if b.num_rows]
    if not tables:
        return
    t = pa.Table.from_batches(tables)
    s = t.column("score").to_numpy()
    pos = t.column("pos").to_numpy().astype(np.float64)
    neg = t.column("neg").to_numpy().astype(np.float64)
    order = np.argsort(s, kind="stable")
    s, pos, neg = s[order], pos[order], neg[order]
    below = np.cumsum(neg) - neg
    area = float(np.sum(pos * (below + 0.5 * neg)))
    yield pa.RecordBatch.from_arrays(
        [pa.array([float(s[0])]), pa.array([area]), pa.array([int(pos.sum())], pa.int64()),
         pa.array([int(neg.sum())], pa.int64())], names=["low", "area", "pos", "neg"])


def auc_frame(df: DataFrame, score: str = "score", label: str = "label", digits: int | None = None,
              bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One-row frame ``(auc, positives, negatives)`` with the exact area under the ROC curve.

    ``auc = Σ_s pos(s) * (neg below s + neg(s) / 2) / (P * N)`` over distinct scores ``s``;
    tied scores count half. Ties are first collapsed by a hash aggregate on the score (so a
    score shared by many rows is one row), the distinct scores are range-partitioned into
    buckets of about ``bucket_rows`` each, and every bucket computes its local area and
    totals in one pass. A bucket's negatives-below offset is the sum of the negatives of
    the buckets under it, so the driver combines one small row per bucket:
    ``area = Σ_b (local_b + pos_b * offset_b)``. ``auc`` is null when one class is missing.
    """
    spark = df.sparkSession
    counts = score_counts(df, score, label, digits).persist()
    try:
        distinct = counts.count()
        buckets = max(1, math.ceil(distinct / bucket_rows))
        ranged = counts.repartitionByRange(buckets, "score") if buckets > 1 else counts.coalesce(1)
        parts = ranged.mapInArrow(_range_area_kernel, "low DOUBLE, area DOUBLE, pos BIGINT, neg BIGINT").toArrow()
    finally:
        counts.unpersist()
    order = np.argsort(parts.column("low").to_numpy(), kind="stable")
    area = parts.column("area").to_numpy()[order]
    pos = parts.column("pos").to_numpy()[order].astype(np.float64)
    neg = parts.column("neg").to_numpy()[order].astype(np.float64)
    offsets = np.cumsum(neg) - neg
    p, n = int(pos.sum()), int(neg.sum())
    value = None if p == 0 or n == 0 else float(np.sum(area + pos * offsets)) / (float(p) * float(n))
    return spark.createDataFrame([(value, p, n)], "auc DOUBLE, positives BIGINT, negatives BIGINT")


def area_under_roc(df: DataFrame, score: str = "score", label: str = "label", digits: int | None = None) -> float | None:
    return auc_frame(df, score, label, digits).collect()[0]["auc"]


def row_loss_frame(df: DataFrame, weights: np.ndarray, loss: MarginLoss, d: int, *, key: str = "key",
                   label: str = "label", features: str = "features") -> DataFrame:
    """Per-row ``(key, label, loss, mult..)`` at fixed weights.

    Single-margin losses are column expressions; multi-output losses (multinomial) use
    their NumPy form in ``mapInArrow`` so the softmax is computed once per row."""
    if loss.outputs > 1 and loss.has_numpy:
        return _row_loss_arrow(df, weights, loss, d, key, label, features)
    staged, margins = staged_margins(df, weights, loss.outputs, d, features,
                                     keep=(F.col(key).alias("key"), F.col(label).cast("double").alias("label")))
    row_loss, mults = loss.columns(margins, F.col("label"))
    names = ["mult"] if len(mults) == 1 else [f"mult_{c + 1}" for c in range(len(mults))]
    return staged.select("key", "label", row_loss.alias("loss"), *[m.alias(nm) for m, nm in zip(mults, names)])


def mean_loss_frame(df: DataFrame, weights: np.ndarray, loss: MarginLoss, d: int, reg_value: float = 0.0,
                    **kw) -> DataFrame:
    """One-row ``(rows, mean_loss, reg, objective)``: whole-table mean loss plus penalty."""
    rl = row_loss_frame(df, weights, loss, d, **kw)
    return rl.agg(F.count(F.lit(1)).alias("rows"), F.avg("loss").alias("mean_loss")).select(
        "rows", "mean_loss", F.lit(float(reg_value)).alias("reg"),
        (F.col("mean_loss") + F.lit(float(reg_value))).alias("objective"))


def weight_norms_frame(weights: DataFrame, reg: float) -> DataFrame:
    """``(l1, l2, reg_l1, reg_l2)`` of an ``(idx, weight)`` table."""
    return weights.agg(F.sum(F.abs("weight")).alias("l1"), F.sqrt(F.sum(F.col("weight") ** 2)).alias("l2")).select(
        "l1", "l2", (F.col("l1") * F.lit(float(reg))).alias("reg_l1"),
        (F.lit(0.5 * float(reg)) * F.col("l2") * F.col("l2")).alias("reg_l2"))


def _row_loss_arrow(df, weights, loss, d, key, label, features):
    import pyarrow as pa

    from slopeline.operators.gradient import features_matrix, label_vector

    k = loss.outputs
    w = np.asarray(weights, dtype=np.float64).reshape(k, d)
    names = [f"mult_{c + 1}" for c in range(k)]

    def kernel(batches):
        for b in batches:
            x = features_matrix(b.column("features"), d)
            y = label_vector(b.column("label"))
            row_loss, mult = loss.numpy(x @ w.T, y) if len(y) else (np.zeros(0), np.zeros((0, k)))
            cols = [b.column("key"), pa.array(y), pa.array(row_loss)] + [pa.array(mult[:, c]) for c in range(k)]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "label", "loss"] + names)

    src = df.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"),
                    F.col(features).alias("features"))
    key_type = src.schema["key"].dataType.simpleString()
    schema = f"key {key_type}, label DOUBLE, loss DOUBLE, " + ", ".join(f"{n} DOUBLE" for n in names)
    return src.mapInArrow(kernel, schema)
