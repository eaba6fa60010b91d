"""Training-table checks: row count, feature dimension and label domain in one aggregate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slopeline.functions.losses import MarginLoss


@dataclass
class TableFacts:
    rows: int
    dim: int
    bad_labels: int = 0
    null_labels: int = 0
    null_features: int = 0
    min_dim: int = 0
    max_dim: int = 0


def label_is_valid(label: Column, loss: MarginLoss, num_classes: int = 2) -> Column:
    """Whether a label fits the loss: {0, 1} for binary losses, {0..K-1} for multinomial,
    any non-null number for least squares."""
    if loss.outputs > 1 or loss.name == "multinomial":
        return (label >= 0) & (label <= F.lit(float(num_classes - 1))) & (label == F.floor(label))
    if loss.binary_labels:
        return label.isin(0.0, 1.0)
    return label.isNotNull()


def table_facts_frame(df: DataFrame, loss: MarginLoss, num_classes: int = 2, label: str = "label",
                      features: str = "features", element_nulls: bool = True) -> DataFrame:
    """One-row frame with the row count and every validation counter.

    ``element_nulls`` also scans every vector entry for nulls (an interpreted
    higher-order function); the Arrow kernels find null entries from Arrow metadata at no
    cost, so trainers that use them skip this scan."""
    y = F.col(label).cast("double")
    x = F.col(features)
    bad_x = (x.isNull() | F.exists(x, lambda v: v.isNull())) if element_nulls else x.isNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.size(x)).alias("min_dim"),
        F.max(F.size(x)).alias("max_dim"),
        F.sum(F.when(y.isNull(), 1).otherwise(0)).alias("null_labels"),
        F.sum(F.when(bad_x, 1).otherwise(0)).alias("null_features"),
        F.sum(F.when(y.isNotNull() & ~label_is_valid(y, loss, num_classes), 1).otherwise(0)).alias("bad_labels"),
    )


def sparse_facts_frame(df: DataFrame, loss: MarginLoss, num_classes: int = 2) -> DataFrame:
    """The counters of :func:`table_facts_frame` for ``struct<indices, values>`` features; the
    dimension is the largest index plus one, and the kernels check the entries themselves."""
    y, x = F.col("label"), F.col("features")
    top = F.max(F.coalesce(F.array_max(x["indices"]), F.lit(-1))) + 1
    return df.agg(
        F.count(F.lit(1)).alias("rows"), top.alias("min_dim"), top.alias("max_dim"),
        F.sum(F.when(y.isNull(), 1).otherwise(0)).alias("null_labels"),
        F.sum(F.when(x.isNull() | x["indices"].isNull() | x["values"].isNull(), 1).otherwise(0)).alias("null_features"),
        F.sum(F.when(y.isNotNull() & ~label_is_valid(y, loss, num_classes), 1).otherwise(0)).alias("bad_labels"))


def check_training_table(df: DataFrame, loss: MarginLoss, num_classes: int = 2, label: str = "label",
                         features: str = "features", element_nulls: bool = True,
                         check_labels: bool = True) -> TableFacts:
    """Count rows and reject nulls, ragged feature vectors and labels outside the loss's
    domain; runs as a single aggregation job."""
    sparse = isinstance(df.schema[features].dataType, StructType)
    r = (sparse_facts_frame(df, loss, num_classes) if sparse
         else table_facts_frame(df, loss, num_classes, label, features, element_nulls)).collect()[0]
    rows = int(r["rows"])
    if rows == 0:
        return TableFacts(0, 0)
    facts = TableFacts(rows, int(r["max_dim"] or 0), int(r["bad_labels"] or 0), int(r["null_labels"] or 0),
                       int(r["null_features"] or 0), int(r["min_dim"] if r["min_dim"] is not None else -1),
                       int(r["max_dim"] if r["max_dim"] is not None else -1))
    if facts.null_labels:
        raise ValueError(f"{facts.null_labels} rows have a null label")
    if facts.null_features:
        raise ValueError(f"{facts.null_features} rows have a null feature vector or entry")
    if facts.min_dim != facts.max_dim:
        raise ValueError(f"feature vectors differ in length ({facts.min_dim} to {facts.max_dim})")
    if facts.bad_labels and check_labels:
        kind = f"0..{num_classes - 1}" if loss.name == "multinomial" else "0 or 1"
        raise ValueError(f"{facts.bad_labels} labels are not {kind}")
    return facts
