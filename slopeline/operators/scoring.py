"""Scoring a table with a linear model, as column expressions.

One margin ``m = x.w + b``: a logistic model's score is ``1 / (1 + e^-m)``, any other
model's the margin itself; with a threshold ``t`` the prediction is ``1.0`` when
``score > t`` (strictly) and ``0.0`` otherwise; without one it is the score.
Multinomial: margins of classes ``1..K-1`` (plus the block's bias slot if present); the
pivot class 0 wins unless some margin is positive, and ties go to the lower class.

Narrow models are unrolled into whole-stage-codegen expressions; past
:data:`~slopeline.functions.linalg.UNROLL_LIMIT` weights the margins come from an Arrow
UDF doing one matrix product per batch on the flat feature buffer. Both reject a vector of
another length, a null vector and a null entry.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from slopeline.functions.linalg import UNROLL_LIMIT, dot_slice, sigmoid
from slopeline.operators.gradient import feature_rows, is_sparse
from slopeline.sources.models import LinearModel


def _margins_udf(model: LinearModel):
    k = max(1, model.num_classes - 1)
    d = model.num_features
    w = model.weights.reshape(k, model.block)
    bias = w[:, d] if model.block == d + 1 else np.full(k, model.intercept if model.num_classes == 2 else 0.0)

    @F.arrow_udf(ArrayType(DoubleType()))
    def margins(features: pa.Array) -> pa.Array:
        m = feature_rows(features, d).margins(w[:, :d]) + bias
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, k, dtype=np.int32)), pa.array(m.ravel()))

    return margins


def checked(features: str, d: int) -> Column:
    """``features`` after the checks that the Arrow form makes too: length ``d``, no nulls."""
    x = F.col(features)
    null = x.isNull()
    for j in range(d):
        null = null | x.getItem(j).isNull()
    return (F.when(x.isNotNull() & (F.size(x) != d), F.raise_error(F.lit(f"feature vectors must all have length {d}")))
            .when(null, F.raise_error(F.lit("null feature vector or entry"))).otherwise(x))


def margin_columns(model: LinearModel, features: str = "features", sparse: bool = False) -> list[Column]:
    """One margin column per non-pivot class (one column for models with one margin);
    ``sparse``: the features are ``struct<indices, values>``."""
    d, k = model.num_features, max(1, model.num_classes - 1)
    if sparse or k * d > UNROLL_LIMIT:
        arr = _margins_udf(model)(F.col(features))
        return [arr.getItem(c) for c in range(k)]
    x = checked(features, d)
    if model.num_classes == 2:
        m = dot_slice(x, model.weights, 0, d)
        return [m + F.lit(float(model.intercept)) if model.intercept else m]
    block = model.block
    return [dot_slice(x, model.weights, c * block, d, c * block + d if model.has_bias_slot else None)
            for c in range(model.num_classes - 1)]


def score_column(model: LinearModel, features: str = "features", sparse: bool = False) -> Column:
    """Score of a model with one margin: a probability, or the margin."""
    if model.num_classes != 2:
        raise ValueError("score_column is for models with one margin; use class_column")
    margin = margin_columns(model, features, sparse)[0]
    return sigmoid(margin) if model.is_probability else margin


def class_column(model: LinearModel, features: str = "features", threshold: float | None = None,
                 sparse: bool = False) -> Column:
    if model.num_classes == 2:
        t = model.threshold if threshold is None else threshold
        if t is None:
            raise ValueError("binary class prediction needs a threshold")
        return F.when(score_column(model, features, sparse) > F.lit(float(t)), F.lit(1.0)).otherwise(F.lit(0.0))
    margins = F.array(*margin_columns(model, features, sparse))
    best = F.array_max(margins)
    return F.when(best > F.lit(0.0), F.array_position(margins, best).cast("double")).otherwise(F.lit(0.0))


def as_arrays(df: DataFrame, features: str = "features") -> DataFrame:
    """``df`` with a Spark ML vector ``features`` column turned into ``ARRAY<DOUBLE>``."""
    if isinstance(df.schema[features].dataType, VectorUDT):
        return df.withColumn(features, vector_to_array(F.col(features), "float64"))
    return df


def predict(df: DataFrame, model: LinearModel, *, features: str = "features", output: str = "prediction",
            keep: list[str] | None = None) -> DataFrame:
    """Add ``output``: the class (binary model with a threshold, or multinomial) or the score
    (binary model whose threshold is cleared)."""
    df = as_arrays(df, features)
    if model.num_classes == 2 and model.threshold is None:
        col = score_column(model, features, is_sparse(df, features))
    else:
        col = class_column(model, features, sparse=is_sparse(df, features))
    base = df if keep is None else df.select(*keep, features)
    return base.withColumn(output, col)


def score_and_label(df: DataFrame, model: LinearModel, *, features: str = "features", label: str = "label",
                    score: str = "score") -> DataFrame:
    """``(label, score)`` pairs of a binary model, the input of the ROC metric."""
    df = as_arrays(df, features)
    return df.select(F.col(label).cast("double").alias("label"), score_column(model, features, is_sparse(df, features)).alias(score))
