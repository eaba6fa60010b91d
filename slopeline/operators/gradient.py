"""Batch gradient aggregation (sum of gradients, sum of losses, row count).

This is the one distributed job every trainer iteration runs. Three kernels compute it, all
returning the same long form ``(slot, value, n)`` (slots ``0..G-1`` the gradient sums, slot
``G`` the loss sum, ``n`` the rows aggregated):

``arrow``
    ``mapInArrow`` hands each partition to NumPy as Arrow batches; the kernel keeps one
    running (gradient, loss, count) partial per partition and emits it in long form. Null
    vector entries are found from Arrow metadata. Best for wide and multinomial models, and
    for small partitions.

``sums``
    The JVM kernel for narrow models: one global aggregate with one ``sum(mult * x_j)`` per
    weight slot over an unrolled, whole-stage-codegen dot product (plus an unrolled null-entry
    count). The weights are data, one broadcast row met by every row, so the generated code
    is the same at every iteration and compiled once. The per-row cost is far below the Arrow
    hand-off; past :data:`SUMS_SLOT_LIMIT` slots the generated code grows too large.

``expr``
    For user losses written only as columns: every row emits its ``mult_c * x_j`` terms and
    its loss by ``posexplode``, and a hash aggregate by slot sums them. The weights enter as
    array literals, so repeated iterations reuse the compiled code.

``auto`` picks by the loss and the width alone, so a fit computes the same way on any layout:
``sums`` for models of at most :data:`SUMS_SLOT_LIMIT` slots, ``arrow`` for wider ones with a
NumPy form, ``expr`` for wider column-only losses.

Merging the Arrow partials works like ``treeAggregate``: while ``partitions x slots`` is at
most :data:`DIRECT_MERGE_LIMIT` values, the partials come straight back from one stage (one
small row per partition) and are summed on the driver; past that bound they are summed by
slot in a shuffle first (map-side partial aggregation), so what reaches the driver stays one
model-sized vector.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slopeline.functions.linalg import dot_array, dot_slice, tree_sum
from slopeline.functions.losses import MarginLoss

DIRECT_MERGE_LIMIT = 1 << 21
SUMS_SLOT_LIMIT = 16
ROW_COLLECT_LIMIT = 1 << 16
SLOT_SCHEMA = "slot INT, value DOUBLE, n BIGINT"


@dataclass
class BatchSums:
    """Result of one aggregation pass: Σ gradient (per weight slot), Σ loss and row count."""

    grad: np.ndarray
    loss: float
    count: int

    @property
    def mean_grad(self) -> np.ndarray:
        return self.grad / float(self.count)

    @property
    def mean_loss(self) -> float:
        return self.loss / float(self.count)


def features_matrix(col: pa.Array, d: int) -> np.ndarray:
    """A list column of fixed length ``d``, or sparse rows, as an (n, d) float64 matrix."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_struct(col.type):
        return SparseRows(col, d).dense()
    n = len(col)
    if n == 0:
        return np.zeros((0, d))
    if col.null_count:
        raise ValueError("null feature vector")
    flat = col.flatten()
    if flat.null_count:
        raise ValueError("null feature entry")
    if len(flat) != n * d:
        raise ValueError(f"feature vectors must all have length {d}")
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, d)


class SparseRows:
    """Rows of ``struct<indices, values>`` over ``d`` features, entry by entry."""

    def __init__(self, col: pa.StructArray, d: int):
        if col.null_count:
            raise ValueError("null feature vector")
        indices, values = col.field("indices"), col.field("values")
        if indices.null_count or values.null_count or indices.flatten().null_count or values.flatten().null_count:
            raise ValueError("null feature entry")
        sizes = np.diff(indices.offsets.to_numpy())
        if not np.array_equal(sizes, np.diff(values.offsets.to_numpy())):
            raise ValueError("a row has more indices than values, or fewer")
        self.n, self.d = len(col), d
        self.row = np.repeat(np.arange(self.n), sizes)
        self.idx = indices.flatten().to_numpy()
        self.val = np.asarray(values.flatten().to_numpy(), dtype=np.float64)
        if len(self.idx) and (self.idx.min() < 0 or self.idx.max() >= d):
            raise ValueError(f"feature indices must lie in 0..{d - 1}")

    def margins(self, w: np.ndarray) -> np.ndarray:
        """(n, k) margins for (k, d) weights."""
        return np.stack([np.bincount(self.row, weights=self.val * wc[self.idx], minlength=self.n) for wc in w], axis=1)

    def gradient(self, mult: np.ndarray) -> np.ndarray:
        """(k, d) sums of multiplier times row, for (n, k) multipliers."""
        return np.stack([np.bincount(self.idx, weights=self.val * m[self.row], minlength=self.d) for m in mult.T])

    def dense(self) -> np.ndarray:
        x = np.zeros((self.n, self.d))
        np.add.at(x, (self.row, self.idx), self.val)
        return x


class DenseRows:
    def __init__(self, col: pa.Array, d: int):
        self.x = features_matrix(col, d)

    def margins(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w.T

    def gradient(self, mult: np.ndarray) -> np.ndarray:
        return mult.T @ self.x


def feature_rows(col: pa.Array, d: int) -> SparseRows | DenseRows:
    """The feature column of an Arrow batch in the form it is stored in."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return SparseRows(col, d) if pa.types.is_struct(col.type) else DenseRows(col, d)


def is_sparse(df: DataFrame, features: str = "features") -> bool:
    return isinstance(df.schema[features].dataType, StructType)


def label_vector(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        raise ValueError("null label")
    return np.asarray(col.to_numpy(zero_copy_only=False), dtype=np.float64)


def slot_batch(values: np.ndarray, n: int) -> pa.RecordBatch:
    """Long form ``(slot, value, n)`` of a partial vector that summarises ``n`` rows."""
    values = np.asarray(values, dtype=np.float64)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values),
         pa.array(np.full(len(values), n, dtype=np.int64))],
        names=["slot", "value", "n"],
    )


def merge_slots(partials: DataFrame) -> DataFrame:
    """Sum long-form partials by slot: map-side partial aggregation, then a final
    aggregation spread over the shuffle partitions by slot. Every partial row carries
    its row count, so each merged slot carries the total count."""
    return partials.groupBy("slot").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))


def collect_sums(frame: DataFrame, slots: int) -> BatchSums:
    """Collect a merged ``(slot, value, n)`` frame (``slots + 1`` rows) into a BatchSums."""
    return sum_partials(fetch_partials(frame, slots + 1), slots)


def arrow_kernel(weights: np.ndarray, loss: MarginLoss, d: int, features: str = "features", label: str = "label"):
    """Per-partition NumPy kernel for ``mapInArrow``: one partial per partition."""
    k = loss.outputs
    w = np.asarray(weights, dtype=np.float64).reshape(k, d)

    def kernel(batches):
        g = np.zeros((k, d))
        loss_sum = 0.0
        n = 0
        for b in batches:
            if b.num_rows == 0:
                continue
            x = feature_rows(b.column(features), d)
            y = label_vector(b.column(label))
            row_loss, mult = loss.numpy(x.margins(w), y)
            g += x.gradient(mult)
            loss_sum += float(row_loss.sum())
            n += b.num_rows
        if n:
            yield slot_batch(np.concatenate([g.ravel(), [loss_sum]]), n)

    return kernel


def training_columns(df: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """``features, label DOUBLE`` view of ``df``; a table already in that shape (as every
    trainer's persisted table is) is used as it is, saving a projection per iteration."""
    if features == "features" and label == "label":
        fields = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        if fields.get("label") == "double" and "features" in fields and "_rid" not in fields:
            return df
    return df.select(F.col(features).alias("features"), F.col(label).cast("double").alias("label"))


def gradient_frame_arrow(df: DataFrame, weights: np.ndarray, loss: MarginLoss, d: int,
                         features: str = "features", label: str = "label") -> DataFrame:
    partials = training_columns(df, features, label).mapInArrow(arrow_kernel(weights, loss, d), SLOT_SCHEMA)
    return merge_slots(partials)


def staged_margins(df: DataFrame, weights: np.ndarray, outputs: int, d: int, features: str = "features",
                   keep: tuple = (), iterative: bool = False) -> tuple[DataFrame, list]:
    """Project the margins of every output once (as one array column ``_margins``) so that
    loss expressions referring to a margin several times reuse the computed value.
    ``iterative`` passes the weights as array literals so repeated plans share compiled code."""
    w = np.asarray(weights, dtype=np.float64)
    if iterative:
        margins = [dot_array(features, w[c * d:(c + 1) * d]) for c in range(outputs)]
    else:
        margins = [dot_slice(features, w, c * d, d) for c in range(outputs)]
    staged = df.select(*keep, F.array(*margins).alias("_margins"))
    return staged, [F.col("_margins").getItem(c) for c in range(outputs)]


def _scaled_by(mult):
    """Element lambda ``v -> v * mult`` (one argument, so ``transform`` passes no index)."""
    return lambda v: v.cast("double") * mult


def gradient_frame_expr(df: DataFrame, weights: np.ndarray, loss: MarginLoss, d: int,
                        features: str = "features", label: str = "label") -> DataFrame:
    """Same long form computed with column expressions: each row emits its gradient terms
    ``mult_c * x_j`` and its loss as ``(slot, value)`` pairs (``posexplode``), and one
    hash aggregate by slot sums them map-side, then per slot."""
    k = loss.outputs
    staged, margins = staged_margins(df, weights, k, d, features, iterative=True,
                                     keep=(F.col(features).alias("_x"), F.col(label).cast("double").alias("_y")))
    row_loss, mults = loss.columns(margins, F.col("_y"))
    terms = [F.transform(F.col("_x"), _scaled_by(m)) for m in mults]
    exploded = staged.select(F.posexplode(F.concat(*terms, F.array(row_loss))).alias("slot", "value"))
    return (exploded.groupBy(F.col("slot").cast("int").alias("slot"))
            .agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")))


def weights_row(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """The weights as one broadcast row ``_w ARRAY<DOUBLE>`` (a local table, model-sized)."""
    values = pa.array([np.asarray(weights, dtype=np.float64).tolist()], pa.list_(pa.float64()))
    return F.broadcast(df.sparkSession.createDataFrame(pa.table({"_w": values})))


def gradient_row_sums(df: DataFrame, weights: np.ndarray, loss: MarginLoss, d: int,
                      features: str = "features", label: str = "label") -> DataFrame:
    """One-row frame ``g_0 .. g_{G-1}, loss_sum, n`` from the JVM ``sums`` kernel."""
    k = loss.outputs
    x, w = F.col("_x"), F.col("_w")
    met = df.select(F.col(features).alias("_x"), F.col(label).cast("double").alias("_y")).crossJoin(weights_row(df, weights))
    margins = [tree_sum([x.getItem(j).cast("double") * w.getItem(c * d + j) for j in range(d)]) for c in range(k)]
    staged = met.select("_x", "_y", *[m.alias(f"_z{c}") for c, m in enumerate(margins)])
    row_loss, mults = loss.columns([F.col(f"_z{c}") for c in range(k)], F.col("_y"))
    staged = staged.select("_x", row_loss.alias("_loss"), *[m.alias(f"_m{c}") for c, m in enumerate(mults)])
    aggs = [F.sum(F.col(f"_m{c}") * F.col("_x").getItem(j).cast("double")).alias(f"g_{c * d + j}")
            for c in range(k) for j in range(d)]
    # null entries would be skipped by sum: count them with an unrolled (codegen) test
    any_null = F.col("_x").isNull()
    for j in range(d):
        any_null = any_null | F.col("_x").getItem(j).isNull()
    return staged.agg(*aggs, F.sum("_loss").alias("loss_sum"), F.count(F.lit(1)).alias("n"),
                      F.sum(F.when(any_null, 1).otherwise(0)).alias("null_entries"))


def gradient_frame_sums(df: DataFrame, weights: np.ndarray, loss: MarginLoss, d: int,
                        features: str = "features", label: str = "label") -> DataFrame:
    slots = loss.slots(d)
    names = [f"g_{s}" for s in range(slots)] + ["loss_sum"]
    return (gradient_row_sums(df, weights, loss, d, features, label).where(F.col("n") > 0)
            .select(F.posexplode(F.array(*names)).alias("slot", "value"), "n")
            .select(F.col("slot").cast("int").alias("slot"), "value", "n"))


def choose_kernel(loss: MarginLoss, d: int, kernel: str = "auto") -> str:
    if kernel != "auto":
        return kernel
    if loss.slots(d) <= SUMS_SLOT_LIMIT:
        return "sums"
    return "arrow" if loss.has_numpy else "expr"


def gradient_frame(df: DataFrame, weights: np.ndarray, loss: MarginLoss, d: int, *,
                   features: str = "features", label: str = "label", kernel: str = "auto") -> DataFrame:
    """Lazy ``(slot, value, n)`` frame: slots ``0..G-1`` hold Σ gradient, slot ``G`` holds
    Σ loss, and ``n`` is the number of rows aggregated (0 rows when the input is empty)."""
    kind = choose_kernel(loss, d, kernel)
    if kind == "expr":
        return gradient_frame_expr(df, weights, loss, d, features, label)
    if kind == "sums":
        return gradient_frame_sums(df, weights, loss, d, features, label)
    if kind == "arrow":
        return gradient_frame_arrow(df, weights, loss, d, features, label)
    raise ValueError(f"unknown kernel {kind!r}")


def batch_sums(df: DataFrame, weights: np.ndarray, loss: MarginLoss, d: int, *,
               features: str = "features", label: str = "label", kernel: str = "auto",
               partitions: int | None = None) -> BatchSums:
    """Run one aggregation pass and bring back Σ gradient, Σ loss and the row count.
    ``partitions``, the number of partitions of ``df`` if the caller knows it, lets few and
    short Arrow partials come back from one stage; asking ``df`` for it would plan it anew."""
    slots = loss.slots(d)
    kind = "arrow" if is_sparse(df, features) else choose_kernel(loss, d, kernel)
    if kind == "sums":
        row = gradient_row_sums(df, weights, loss, d, features, label).collect()[0]
        if row["null_entries"]:
            raise ValueError("null feature entry")
        n = int(row["n"])
        if n == 0:
            return BatchSums(np.zeros(slots), 0.0, 0)
        return BatchSums(np.array([row[f"g_{s}"] for s in range(slots)], dtype=np.float64),
                         float(row["loss_sum"]), n)
    if kind == "arrow" and partitions is not None and partitions * (slots + 1) <= DIRECT_MERGE_LIMIT:
        partials = training_columns(df, features, label).mapInArrow(arrow_kernel(weights, loss, d), SLOT_SCHEMA)
        return sum_partials(fetch_partials(partials, partitions * (slots + 1)), slots)
    frame = gradient_frame(df, weights, loss, d, features=features, label=label, kernel=kind)
    return collect_sums(frame, slots)


def fetch_partials(partials: DataFrame, expected_rows: int) -> pa.Table:
    """Bring a bounded number of long-form partial rows to the driver: plain ``collect``
    for a few rows (lowest latency), Arrow collection for many."""
    if expected_rows > ROW_COLLECT_LIMIT:
        return partials.toArrow()
    rows = partials.collect()
    return pa.table({"slot": pa.array([r[0] for r in rows], pa.int32()),
                     "value": pa.array([r[1] for r in rows], pa.float64()),
                     "n": pa.array([r[2] for r in rows], pa.int64())})


def sum_partials(table: pa.Table, slots: int) -> BatchSums:
    """Driver-side sum of per-partition long-form partials (bounded by DIRECT_MERGE_LIMIT)."""
    slot = table.column("slot").to_numpy()
    acc = np.bincount(slot, weights=table.column("value").to_numpy(), minlength=slots + 1)
    n = int(table.column("n").to_numpy()[slot == slots].sum())
    return BatchSums(acc[:slots].astype(np.float64), float(acc[slots]), n)


def mean_gradient_frame(df: DataFrame, weights: np.ndarray, loss: MarginLoss, d: int, **kw) -> DataFrame:
    """Lazy ``(idx, grad)`` table of the batch mean gradient (no rows for an empty batch)."""
    slots = loss.slots(d)
    frame = gradient_frame(df, weights, loss, d, **kw)
    return frame.where(F.col("slot") < slots).select(
        F.col("slot").alias("idx"), (F.col("value") / F.col("n")).alias("grad"))
