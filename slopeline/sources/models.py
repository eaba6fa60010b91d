"""Linear models and their storage as a one-row Parquet table.

A model holds the loss it was trained for (its kind), the weights, the intercept (models
with one margin), the number of features and classes, and an optional decision threshold.
A logistic model scores probabilities, a hinge model margins; either gives class 1.0 above
its threshold. A least-squares model gives the margin, and so does a user loss unless its
labels are 0 and 1. Multinomial weights are one flat class-major
vector of ``(K-1) * d`` entries, or ``(K-1) * (d+1)`` when each class block ends with its
bias slot; class 0 is the pivot.

A wide model is too large for one row: its weights are a partitioned table ``weights`` and its one-row
``manifest`` holds the rest, with the number of weight rows and a checksum of them. The manifest is
written last, so a model whose write broke off has none and is refused, and so is one whose
weights are not those that the manifest describes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeline.session import path_exists

# The stored format tag, the kinds of the built-in losses and the decision
# threshold of each (None: no classes, the margin is the prediction).
FORMAT = "slopeline-linear/1"
KIND = "logistic"
DEFAULT_THRESHOLD = 0.5
KIND_THRESHOLDS = {"logistic": DEFAULT_THRESHOLD, "multinomial": DEFAULT_THRESHOLD, "hinge": 0.0,
                   "least_squares": None, "margin_classes": 0.0, "margin": None}

MODEL_SCHEMA = ("format STRING, kind STRING, num_features INT, num_classes INT, "
                "weights ARRAY<DOUBLE>, intercept DOUBLE, threshold DOUBLE")


@dataclass
class LinearModel:
    weights: np.ndarray
    intercept: float = 0.0
    num_features: int = field(default=-1)
    num_classes: int = 2
    threshold: float | None = DEFAULT_THRESHOLD
    kind: str = KIND

    def __post_init__(self):
        if self.kind not in KIND_THRESHOLDS:
            raise ValueError(f"model kind must be one of {sorted(KIND_THRESHOLDS)}, got {self.kind!r}")
        self.weights = np.asarray(self.weights, dtype=np.float64)
        if self.num_features < 0:
            self.num_features = len(self.weights) if self.num_classes == 2 else len(self.weights) // (self.num_classes - 1)
        if self.num_classes == 2:
            if len(self.weights) != self.num_features:
                raise ValueError(f"binary model needs {self.num_features} weights, got {len(self.weights)}")
        else:
            k = self.num_classes - 1
            if len(self.weights) not in (k * self.num_features, k * (self.num_features + 1)):
                raise ValueError(
                    f"multinomial model with {self.num_classes} classes and {self.num_features} features needs "
                    f"{k * self.num_features} or {k * (self.num_features + 1)} weights, got {len(self.weights)}")

    @property
    def block(self) -> int:
        """Weights per class block (``d`` or ``d + 1`` with a bias slot)."""
        return len(self.weights) if self.num_classes == 2 else len(self.weights) // (self.num_classes - 1)

    @property
    def has_bias_slot(self) -> bool:
        return self.num_classes > 2 and self.block == self.num_features + 1

    @property
    def is_probability(self) -> bool:
        """Whether the score of the single margin is a probability (else it is the margin)."""
        return self.kind in ("logistic", "multinomial")

    def with_threshold(self, threshold: float | None) -> "LinearModel":
        return LinearModel(self.weights, self.intercept, self.num_features, self.num_classes, threshold, self.kind)

    def clear_threshold(self) -> "LinearModel":
        return self.with_threshold(None)

    def predict_point(self, features) -> float:
        """Prediction for one feature vector on the driver, with the same rules as the
        column expressions of ``slopeline.operators.scoring``."""
        x = np.asarray(features, dtype=np.float64)
        if len(x) != self.num_features:
            raise ValueError(f"expected {self.num_features} features, got {len(x)}")
        if self.num_classes == 2:
            score = float(x @ self.weights) + self.intercept
            if self.is_probability:
                score = 1.0 / (1.0 + np.exp(-score))
            return score if self.threshold is None else float(score > self.threshold)
        w = self.weights.reshape(self.num_classes - 1, self.block)
        margins = w[:, :self.num_features] @ x + (w[:, -1] if self.has_bias_slot else 0.0)
        best = int(np.argmax(margins))
        return float(best + 1) if margins[best] > 0 else 0.0

    def weights_frame(self, spark: SparkSession) -> DataFrame:
        """``(idx, weight)`` table of the weight vector."""
        return spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(self.weights)], "idx INT, weight DOUBLE")


def save_model(spark: SparkSession, model: LinearModel, path: str, mode: str = "error") -> str:
    """Write the model as a one-row Parquet table at ``path`` (a shared folder)."""
    row = (FORMAT, model.kind, int(model.num_features), int(model.num_classes),
           [float(v) for v in model.weights], float(model.intercept),
           None if model.threshold is None else float(model.threshold))
    spark.createDataFrame([row], MODEL_SCHEMA).coalesce(1).write.mode(mode).parquet(path)
    return path


def load_model(spark: SparkSession, path: str) -> LinearModel:
    """Read a model written by :func:`save_model`; the format tag is checked."""
    rows = spark.read.parquet(path).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} does not hold exactly one model row")
    r = rows[0]
    if r["format"] != FORMAT or r["kind"] not in KIND_THRESHOLDS:
        raise ValueError(f"unrecognised model: {path} holds format {r['format']!r}, kind {r['kind']!r}: cannot be read as {FORMAT!r}")
    return LinearModel(np.array(r["weights"], dtype=np.float64), float(r["intercept"]), int(r["num_features"]),
                       int(r["num_classes"]), r["threshold"], r["kind"])


def model_frame(spark: SparkSession, path: str) -> DataFrame:
    """The stored model row as a DataFrame, weights exploded to ``(idx, weight)``."""
    return (spark.read.parquet(path)
            .select("num_features", "num_classes", "intercept", "threshold",
                    F.posexplode("weights").alias("idx", "weight")))


WIDE_FORMAT = "slopeline-wide/1"
MANIFEST_SCHEMA = ("format STRING, kind STRING, num_features INT, num_classes INT, intercepts ARRAY<DOUBLE>, "
                   "threshold DOUBLE, weight_rows BIGINT, checksum BIGINT")


@dataclass
class WideModel:
    """A model whose weights are a table ``(idx, weight)``, or ``(class, idx, weight)``."""

    weights: DataFrame
    num_features: int
    num_classes: int = 2
    intercepts: tuple = ()
    threshold: float | None = DEFAULT_THRESHOLD
    kind: str = KIND

    def predict(self, entries: DataFrame, *, keys: DataFrame | None = None, output: str = "prediction") -> DataFrame:
        """Score long-form entries as :func:`slopeline.operators.wide.predict_wide`."""
        from slopeline.operators.wide import predict_wide

        return predict_wide(entries, self.weights, keys=keys, intercept=self.intercepts or 0.0, threshold=self.threshold,
                            num_features=self.num_features, output=output, kind=self.kind)


def wide_model(result, threshold: float | None | str = "default") -> WideModel:
    """The model of a wide fit; its kind and its threshold come from the loss."""
    kind = {"multinomial": "multinomial" if result.num_classes > 2 else "logistic"}.get(result.loss, result.loss)
    kind = kind if kind in KIND_THRESHOLDS else "margin"
    return WideModel(result.weights, result.num_features, result.num_classes, tuple(result.intercepts),
                     KIND_THRESHOLDS[kind] if threshold == "default" else threshold, kind)


def _weight_facts(weights: DataFrame) -> tuple[int, int]:
    """Rows and an order-free checksum of a weight table (one aggregate)."""
    names = [c for c in ("class", "idx", "weight") if c in weights.columns]
    r = weights.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*names)).alias("x")).first()
    return int(r["n"]), int(r["x"] or 0)


def save_wide_model(model: WideModel, path: str) -> str:
    """Write a wide model to a new folder ``path``: the weights first, the manifest last."""
    spark = model.weights.sparkSession
    path = path.rstrip("/")
    model.weights.write.parquet(f"{path}/weights")  # an error where there is one already
    rows, checksum = _weight_facts(spark.read.parquet(f"{path}/weights"))
    row = (WIDE_FORMAT, model.kind, int(model.num_features), int(model.num_classes), [float(b) for b in model.intercepts],
           None if model.threshold is None else float(model.threshold), rows, checksum)
    spark.createDataFrame([row], MANIFEST_SCHEMA).coalesce(1).write.parquet(f"{path}/manifest")
    return path


def load_wide_model(spark: SparkSession, path: str) -> WideModel:
    """Read a model written by :func:`save_wide_model`; count and checksum of its weights are checked."""
    path = path.rstrip("/")
    if not path_exists(spark, f"{path}/manifest/_SUCCESS"):
        raise ValueError(f"{path} holds no finished wide model: its manifest is missing")
    r = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest").first()
    if r is None or r["format"] != WIDE_FORMAT or r["kind"] not in KIND_THRESHOLDS:
        raise ValueError(f"unrecognised model: {path} cannot be read as {WIDE_FORMAT!r}")
    weights = spark.read.parquet(f"{path}/weights")
    if _weight_facts(weights) != (r["weight_rows"], r["checksum"]):
        raise ValueError(f"the weights under {path} are not those of its manifest")
    return WideModel(weights, r["num_features"], r["num_classes"], tuple(r["intercepts"]), r["threshold"], r["kind"])
