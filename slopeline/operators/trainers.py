"""Iterative trainers: mini-batch SGD, Momentum, AdaGrad, AdaDelta, Adam, and the two
variance-reduced trainers (SVRG with gradient aggregation, SVRG with weight averaging).

All share one loop::

    validate + count (one aggregate) -> persist the projected training table
    for i in 1..iters:
        batch  = keyed sample of the table (seed base + i)
        sums   = one aggregation job (Σ gradient, Σ loss, rows)   # or a shard walk (SVRG)
        empty batch -> keep weights, next iteration
        history += mean loss + penalty of the current weights
        weights, state = update rule(...)
        stop once |w_prev - w| < tol * max(|w|, 1) (from the second update on)

Weights and optimiser state are model-sized NumPy vectors on the driver (dense mode); the
data stays on the executors and is read once per iteration from the persisted table.
For models too wide for the driver see :mod:`slopeline.operators.wide`.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.errors import PythonException
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeline.functions.losses import MarginLoss, resolve_loss
from slopeline.functions.sampling import BASE_SEED, SAMPLERS, keyed_sample
from slopeline.operators import svrg as svrg_ops
from slopeline.operators.gradient import batch_sums, is_sparse
from slopeline.operators.updates import (PENALTIES, STATE, StepContext, apply_rule, init_state, penalty_value,
                                         records_history, reg_penalty)
from slopeline.operators.validate import TableFacts, check_training_table
from slopeline.sources.models import KIND_THRESHOLDS, LinearModel

METHODS = ("sgd", "momentum", "adagrad", "adadelta", "adam", "svrg", "svrg_avg")
# Dense mode keeps the weights on the driver and ships them with every task; past this many
# weight slots the weights belong in a table (``slopeline.operators.wide.fit_wide``).
DENSE_SLOT_LIMIT = 1 << 22
VARIANTS = ("published", "observed")
# Copies of a row that one task unfolds at a time.
UNFOLD_ROWS = 1 << 16


@dataclass(frozen=True)
class TrainConfig:
    """Trainer parameters, checked on construction.

    ``fraction`` is the mini-batch fraction, ``mean_fraction`` the fraction of rows used for
    the full-gradient estimate of ``svrg_avg``. ``tol`` is the relative weight-change
    tolerance. ``sampler`` picks the keyed hash (``xxhash64``/``md5``) or layout-dependent
    ``bernoulli``, which depends on the input's partitions. ``partitions`` re-partitions the
    training table (None: as the input has it). ``shards`` is the number of SVRG shards,
    which the result depends on; shards that hold more than ``max_shard_bytes`` of features on
    average are streamed in the order of their walk instead of walked in memory.
    ``order`` is the row order of a shard walk (``random``: draws from md5 of seed,
    iteration, shard and step; ``key``: by key).
    ``update`` is a user rule ``(w, g, state, ctx) -> (w, state)`` that replaces the
    method's rule (the state starts as an empty dict). With ``intercept=True``,
    ``penalise_bias=False`` leaves the bias slot of each class block out of the penalty
    (by default every slot is penalised, as in the original trainers). ``sample_by="row"``
    salts the keyed mini-batch hash with a stable row id, so a hot key or a block of copied
    rows is sampled row by row; ``"key"`` hashes the key alone (the same batches under any
    layout and in SQL; right when the key names a row). ``validate=False`` skips the label
    domain check (rows, nulls and vector lengths are always checked).
    """

    def needs_row_ids(self) -> bool:
        svrg_hash = self.method in ("svrg", "svrg_avg") and self.shard_by == "hash"
        sampled = self.sample_by == "row" and self.sampler != "bernoulli" and (
            self.fraction < 1.0 or (self.method == "svrg_avg" and self.mean_fraction < 1.0))
        return svrg_hash or sampled

    def salt(self) -> str | None:
        return "_rid" if self.sample_by == "row" else None

    loss: str | MarginLoss = "logistic"
    method: str = "sgd"
    penalty: str = "l2"
    step: float = 1.0
    iters: int = 100
    reg: float = 0.0
    fraction: float = 1.0
    mean_fraction: float = 1.0
    tol: float = 1e-7
    variant: str = "published"
    sampler: str = "xxhash64"
    seed: int = BASE_SEED
    num_classes: int = 2
    intercept: bool = False
    partitions: int | None = None
    shards: int = 16
    max_shard_bytes: int = 512 << 20
    shard_by: str = "hash"
    order: str = "random"
    kernel: str = "auto"
    update: Callable | None = None
    penalise_bias: bool = True
    sample_by: str = "row"
    validate: bool = True

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, got {self.method!r}")
        if self.penalty not in PENALTIES:
            raise ValueError(f"penalty must be one of {PENALTIES}, got {self.penalty!r}")
        if self.variant not in VARIANTS:
            raise ValueError(f"variant must be one of {VARIANTS}, got {self.variant!r}")
        if self.sampler not in SAMPLERS:
            raise ValueError(f"sampler must be one of {SAMPLERS}, got {self.sampler!r}")
        if not self.step > 0:
            raise ValueError(f"step must be > 0, got {self.step}")
        if not 0 < self.fraction <= 1:
            raise ValueError(f"fraction must be in (0, 1], got {self.fraction}")
        if not 0 < self.mean_fraction <= 1:
            raise ValueError(f"mean_fraction must be in (0, 1], got {self.mean_fraction}")
        if self.iters < 0:
            raise ValueError(f"iters must be >= 0, got {self.iters}")
        if self.reg < 0:
            raise ValueError(f"reg must be >= 0, got {self.reg}")
        if not 0 <= self.tol <= 1:
            raise ValueError(f"tol must be in [0, 1], got {self.tol}")
        if self.num_classes < 2:
            raise ValueError("num_classes must be >= 2")
        if self.method in ("adagrad", "adadelta", "adam", "svrg", "svrg_avg") and self.penalty == "l1":
            raise ValueError(f"{self.method} supports penalty 'none' or 'l2' only")
        if self.shards < 1:
            raise ValueError("shards must be >= 1")
        if self.partitions is not None and self.partitions < 1:
            raise ValueError("partitions must be >= 1")
        if self.shard_by not in ("hash", "key_mod"):
            raise ValueError("shard_by must be 'hash' or 'key_mod'")
        if self.order not in ("random", "key"):
            raise ValueError("order must be 'random' or 'key'")
        if self.sample_by not in ("row", "key"):
            raise ValueError("sample_by must be 'row' or 'key'")
        if self.fraction < 1.0 and self.tol > 0.0:
            warnings.warn(f"the convergence tolerance tol={self.tol} meets batches that differ (fraction={self.fraction}): it may stop early or late", stacklevel=3)
        if self.iters * self.fraction < 1.0 and self.iters > 0:
            warnings.warn(f"iters={self.iters} at fraction={self.fraction}: not every row is read",
                          stacklevel=3)

    def effective_reg(self) -> float:
        return 0.0 if self.penalty == "none" else self.reg

    def reg_weights(self, slots: int, outputs: int):
        """The regularisation weight per slot: a scalar, or a vector with 0 at the bias
        slots when the intercept is not penalised."""
        reg = self.effective_reg()
        if not self.intercept or self.penalise_bias or reg == 0.0:
            return reg
        vec = np.full(slots, reg)
        vec[slots // outputs - 1::slots // outputs] = 0.0
        return vec


@dataclass
class HistoryEntry:
    iteration: int
    loss: float
    reg: float
    batch_rows: int

    @property
    def total(self) -> float:
        return self.loss + self.reg


@dataclass
class FitResult:
    """Model, raw weight vector, per-iteration history and run facts of one fit."""

    model: LinearModel
    weights: np.ndarray
    history: list[HistoryEntry] = field(default_factory=list)
    iterations: int = 0
    updates: int = 0
    converged: bool = False
    rows: int = 0
    elapsed_ms: float = 0.0

    @property
    def loss_history(self) -> list[float]:
        """Mean batch loss plus penalty, one value per non-empty iteration."""
        return [h.total for h in self.history]

    def last_losses(self, k: int = 10) -> list[float]:
        return self.loss_history[-k:]

    def weights_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(int(i), float(v)) for i, v in enumerate(self.weights)],
                                     "idx INT, weight DOUBLE")

    def history_frame(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(h.iteration, float(h.loss), float(h.reg), float(h.total), int(h.batch_rows)) for h in self.history],
            "iter INT, loss DOUBLE, reg DOUBLE, total DOUBLE, batch_rows BIGINT")


def _unfolded(counted: DataFrame) -> DataFrame:
    """``_n`` rows for each row of ``counted``, numbered from 1 in ``_copy``."""
    cols = ["key", "label", "features"]
    few = counted.filter(F.col("_n") <= UNFOLD_ROWS).select(*cols, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
    starts = F.sequence(F.lit(1).cast("long"), F.col("_n"), F.lit(UNFOLD_ROWS).cast("long"))
    ranges = counted.filter(F.col("_n") > UNFOLD_ROWS).select(*cols, "_n", F.explode(starts).alias("_from"))
    # a keyless deal: the ranges of one row go to all partitions in turn
    spread = ranges.repartition(int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    upto = F.least(F.col("_n"), F.col("_from") + F.lit(UNFOLD_ROWS - 1))
    return few.unionByName(spread.select(*cols, F.explode(F.sequence(F.col("_from"), upto)).alias("_copy")))


def prepare(df: DataFrame, *, key: str = "key", label: str = "label", features: str = "features",
            intercept: bool = False, row_ids: bool = False) -> DataFrame:
    """Project the training columns (``key, label, features``) and optionally append the
    constant-1 intercept feature and a row id (for salting draws and SVRG shards).

    The id hashes the row's content and its number among equal rows, so it is the same under
    any layout and after a lost executor, and copies of a row get ids of their own. Equal rows
    are counted (which combines on the map side) and numbered by unfolding the count. A count above
    :data:`UNFOLD_ROWS` is cut into ranges first, and the ranges are dealt to all partitions before
    they are unfolded, so that no task makes all copies of a row. A table without a ``key`` column
    gets the content hash as its key."""
    feats = F.col(features)
    if isinstance(df.schema[features].dataType, VectorUDT):
        feats = vector_to_array(feats, "float64")
    k = F.col(key) if key in df.columns else F.xxhash64(F.col(label), feats)
    rows = df.select(k.alias("key"), F.col(label).cast("double").alias("label"), feats.alias("features"))
    if row_ids:
        rows = _unfolded(rows.groupBy("key", "label", "features").agg(F.count(F.lit(1)).alias("_n")))
        rows = rows.select("key", "label", "features", F.xxhash64("label", "features", "_copy").alias("_rid"))
    if intercept:
        rows = rows.withColumn("features", F.concat(F.col("features").cast("array<double>"), F.array(F.lit(1.0))))
    return rows


@dataclass
class PreparedTable:
    """A training table that is projected, numbered, checked and cached once, for any number of fits
    (``fit(prepared, config)``). Shards of the variance-reduced trainers are kept too. ``close`` (or
    leaving a ``with`` block) releases what is cached."""

    table: DataFrame
    facts: TableFacts
    sparse: bool
    intercept: bool
    checked: tuple
    partitions: int
    row_ids: bool
    sharded: dict = field(default_factory=dict)

    def shards(self, cfg: TrainConfig, rows: DataFrame) -> DataFrame:
        """``rows`` (the table, with a sparse intercept if asked for) in cached shards."""
        kind = (cfg.shards, cfg.shard_by)
        if kind not in self.sharded:
            self.sharded[kind] = svrg_ops.sharded_table(rows, cfg, cfg.shards)
            self.sharded[kind].count()
        return self.sharded[kind]

    def check_labels(self, loss: MarginLoss, cfg: TrainConfig) -> None:
        """Check the labels for a loss other than the one the table was prepared for."""
        kind = _label_rule(loss, cfg)
        if cfg.validate and kind != self.checked and self.facts.rows:
            check_training_table(self.table, loss, num_classes=getattr(loss, "num_classes", cfg.num_classes), element_nulls=False)
            self.checked = kind

    def close(self) -> None:
        for each in self.sharded.values():
            each.unpersist()
        self.sharded.clear()
        self.table.unpersist()

    def __enter__(self):
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def _label_rule(loss: MarginLoss, cfg: TrainConfig) -> tuple:
    return loss.name, loss.binary_labels, getattr(loss, "num_classes", cfg.num_classes)


def prepared(df: DataFrame, config: TrainConfig | None = None, *, key: str = "key", label: str = "label", features: str = "features",
             row_ids: bool | None = None, **overrides) -> PreparedTable:
    """Project, number, check and cache a training table for fits with ``config`` and others that share
    its intercept and feature form. ``row_ids`` (default: as ``config`` needs) numbers the rows,
    which sampling by row and hashed shards read."""
    cfg = replace(config or TrainConfig(), **overrides) if overrides else (config or TrainConfig())
    loss = resolve_loss(cfg.loss, cfg.num_classes)
    sparse = is_sparse(df, features)
    if cfg.method in STATE and sparse and not loss.has_numpy:
        raise ValueError("sparse features need a loss with a numpy form")
    numbered = cfg.needs_row_ids() if row_ids is None else row_ids
    if "_rid" in df.columns:  # numbered before, such as the parts of a row split
        table = df.select(F.col(key).alias("key"), F.col(label).cast("double").alias("label"), F.col(features).alias("features"), "_rid")
        numbered = True
        if cfg.intercept and not sparse:
            table = table.withColumn("features", F.concat(F.col("features").cast("array<double>"), F.array(F.lit(1.0))))
    else:
        table = prepare(df, key=key, label=label, features=features, intercept=cfg.intercept and not sparse, row_ids=numbered)
    if cfg.partitions:
        table = table.repartition(cfg.partitions)
    table = table.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # the Arrow and sums kernels (and the shard walks) reject null vector entries
        # themselves; only the explode kernel needs the element scan here
        kernel_checks = (cfg.method in ("svrg", "svrg_avg") or cfg.kernel in ("arrow", "sums")
                         or (cfg.kernel == "auto" and loss.has_numpy))
        facts = check_training_table(table, loss, num_classes=getattr(loss, "num_classes", cfg.num_classes), element_nulls=not kernel_checks,
                                     check_labels=cfg.validate)
    except BaseException:
        table.unpersist()
        raise
    return PreparedTable(table, facts, sparse, cfg.intercept, _label_rule(loss, cfg), table.rdd.getNumPartitions(), numbered)


def fit(df: DataFrame | PreparedTable, config: TrainConfig | None = None, *, key: str = "key", label: str = "label",
        features: str = "features", initial_weights=None, num_features: int | None = None, **overrides) -> FitResult:
    """Train a linear model on ``df``, a table or a :class:`PreparedTable`, with ``config``. ``features`` is an array, a Spark ML vector
    or a sparse ``struct<indices, values>``, whose width is ``num_features`` (default: the
    largest index plus one; larger indices are an error). Sparse rows stay sparse.

    Keyword overrides replace fields of ``config`` (``fit(df, method="adam", step=0.01)``).
    """
    cfg = replace(config or TrainConfig(), **overrides) if overrides else (config or TrainConfig())
    loss = resolve_loss(cfg.loss, cfg.num_classes)
    if cfg.method in ("svrg", "svrg_avg") and not loss.has_numpy:
        raise ValueError(f"{cfg.method} walks rows in NumPy; the loss needs a numpy form")
    started = time.perf_counter()
    own = not isinstance(df, PreparedTable)
    ready = prepared(df, cfg, key=key, label=label, features=features) if own else df
    if not own and (ready.intercept != cfg.intercept or (cfg.needs_row_ids() and not ready.row_ids)):
        raise ValueError("the table was prepared with another intercept, or without the row ids that this fit needs")
    table, facts, sparse = ready.table, ready.facts, ready.sparse
    try:
        ready.check_labels(loss, cfg)
        d = facts.dim if facts.rows else (
            None if initial_weights is None else len(initial_weights) // loss.outputs)
        if sparse and num_features is not None:
            if facts.rows and facts.dim > num_features:
                raise ValueError(f"features have index {facts.dim - 1}, beyond num_features={num_features}")
            d = num_features
        if d is None:
            d = 0
        if sparse and cfg.intercept and facts.rows:
            x = F.col("features")  # the bias is one more entry of every row
            trained = table.withColumn("features", F.struct(
                F.concat(x["indices"], F.array(F.lit(d).cast("int"))).alias("indices"),
                F.concat(x["values"], F.array(F.lit(1.0))).alias("values")))
            d += 1
        else:
            trained = table
        if loss.slots(d) > DENSE_SLOT_LIMIT:
            raise ValueError(f"{loss.slots(d)} weight slots is too wide for dense mode; use fit_wide")
        w = np.zeros(loss.slots(d)) if initial_weights is None else np.asarray(initial_weights, dtype=np.float64).copy()
        if len(w) != loss.slots(d):
            raise ValueError(f"initial weights need {loss.slots(d)} entries, got {len(w)}")
        result = FitResult(model=_model(w, cfg, loss, d), weights=w, rows=facts.rows)
        if facts.rows == 0:
            warnings.warn("no training rows; returning the initial weights", stacklevel=2)
            return result
        if facts.rows * cfg.fraction < 1:
            warnings.warn(f"fraction={cfg.fraction} of {facts.rows} rows is less than one row a batch", stacklevel=2)
        try:
            if cfg.method in STATE:
                _run_gradient_loop(trained, cfg, loss, d, w, result, ready.partitions, facts.rows)
            else:
                sharded = ready.shards(cfg, trained)
                if own:
                    table.unpersist()  # one cached copy is enough
                svrg_ops.run(sharded, cfg, loss, d, w, result, facts.rows)
        except PythonException as exc:
            # a kernel rejected the data (e.g. a null vector entry): report it as the
            # validation error it is
            msg = str(exc)
            if "ValueError: " in msg:
                raise ValueError(msg.split("ValueError: ", 1)[1].splitlines()[0]) from exc
            raise
        result.model = _model(result.weights, cfg, loss, d)
        result.elapsed_ms = (time.perf_counter() - started) * 1000.0
        return result
    finally:
        if own:
            ready.close()


def _model(w: np.ndarray, cfg: TrainConfig, loss: MarginLoss, d: int) -> LinearModel:
    """The model of the trained weights: its kind and classes come from the loss."""
    features = d - 1 if cfg.intercept else d
    if loss.outputs > 1:
        return LinearModel(w.copy(), 0.0, features, loss.outputs + 1, kind="multinomial")
    kind = {"multinomial": "logistic"}.get(loss.name, loss.name)  # two classes: one margin
    if kind not in KIND_THRESHOLDS:
        kind = "margin_classes" if loss.binary_labels else "margin"
    weights, bias = (w[:-1].copy(), float(w[-1])) if cfg.intercept else (w.copy(), 0.0)
    return LinearModel(weights, bias, features, 2, KIND_THRESHOLDS[kind], kind)


def converged(prev: np.ndarray, cur: np.ndarray, tol: float) -> bool:
    """``|prev - cur| < tol * max(|cur|, 1)`` in the Euclidean norm."""
    return float(np.linalg.norm(prev - cur)) < tol * max(float(np.linalg.norm(cur)), 1.0)


def _run_gradient_loop(table: DataFrame, cfg: TrainConfig, loss: MarginLoss, d: int, w: np.ndarray,
                       result: FitResult, partitions: int, rows: int) -> None:
    reg = cfg.reg_weights(loss.slots(d), loss.outputs)
    shown_penalty = reg_penalty(cfg.method, cfg.penalty)
    state = {} if cfg.update is not None else init_state(cfg.method, w)
    rule = cfg.update or (lambda w_, g_, s_, c_: apply_rule(cfg.method, w_, g_, s_, c_))
    reg_val = penalty_value(w, reg, shown_penalty)
    keep_history = records_history(cfg.method, cfg.variant)
    updates = 0
    i = 1
    while i <= cfg.iters:
        batch = keyed_sample(table, "key", cfg.fraction, cfg.seed + i, cfg.sampler, cfg.salt())
        sums = batch_sums(batch, w, loss, d, kernel=cfg.kernel, partitions=partitions)
        if sums.count > 0:
            if keep_history:
                result.history.append(HistoryEntry(i, sums.mean_loss, reg_val, sums.count))
            ctx = StepContext(i=i, t=updates, step=cfg.step, reg=reg, penalty=cfg.penalty, variant=cfg.variant)
            new_w, state = rule(w, sums.mean_grad, state, ctx)
            reg_val = penalty_value(new_w, reg, shown_penalty)
            updates += 1
            stop = updates >= 2 and converged(w, new_w, cfg.tol)
            w = new_w
            if stop:
                result.converged = True
                result.iterations = i
                break
        else:
            warnings.warn(f"iteration {i}/{cfg.iters}: the sampled batch is empty", stacklevel=3)
        result.iterations = i
        i += 1
    result.weights = w
    result.updates = updates
