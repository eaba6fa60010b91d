"""Wide (sparse) mode: features, weights, gradient and optimiser state are all tables.

For models too wide to keep on the driver, the training table is the long form
``(key, idx, value)`` -- only non-zero entries are rows -- plus ``(key, label)``. Weights are
a table by ``idx``, or by ``(class, idx)`` for a loss with several margins. One iteration is
one job:

1. margins: ``entries ⋈ weights`` on ``idx``, summed by ``key`` and class (the weight side is
   broadcast while its rows, 12 bytes each, number at most :data:`BROADCAST_WEIGHTS_ROWS`,
   else a shuffle join, in which adaptive execution splits an index that most rows share),
   left-joined to the sampled ``(key, label)`` rows;
2. per-key loss and multipliers as column expressions (the loss's ``columns`` form);
3. gradient: ``entries ⋈ (key, mult)`` on ``key`` summed by ``idx`` and class -- entries and the
   per-key frame are both hash-partitioned by ``key``, so this join adds no shuffle of the
   entries; the sum aggregates map-side first;
4. the update rule as one projection over ``weights ⟕ gradient`` and the batch's one row of
   totals (the same rule code as dense mode, applied to columns; a user rule too);
5. the new weight table is written to the shared checkpoint folder and read back, and the
   previous one deleted: every iteration plans from a plain scan, so plans and iteration
   times do not grow, and a lost executor costs one iteration at most. The row count, loss
   and norms are observed while it is written.

An intercept is a number a class beside the table: it is added to the margins, its gradient is the
mean multiplier, and no entry is needed for it. The variance-reduced trainers walk the rows of a shard
with lazy steps (:mod:`slopeline.operators.lazy_walks`): a shard gets the weights of the indices it
holds, and returns what it did to them.

Only scalars (row count, loss sum, norms, intercepts) reach the driver.
"""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from slopeline.functions.losses import MultinomialLoss, resolve_loss
from slopeline.functions.sampling import keyed_sample
from slopeline.operators import lazy_walks
from slopeline.operators.gradient import SparseRows, label_vector
from slopeline.operators.trainers import HistoryEntry, TrainConfig
from slopeline.operators.updates import STATE, ColumnOps, StepContext, UpdateRule, apply_rule, penalised_step, records_history, reg_penalty
from slopeline.operators.validate import label_is_valid
from slopeline.session import remove_path, scratch_path

BROADCAST_WEIGHTS_ROWS = 2_000_000


@dataclass
class WideFitResult:
    """``weights``: ``(idx, weight)``, or ``(class, idx, weight)`` for several margins; ``intercepts``
    one number a margin (empty without an intercept)."""

    weights: DataFrame
    history: list[HistoryEntry] = field(default_factory=list)
    iterations: int = 0
    updates: int = 0
    converged: bool = False
    intercepts: tuple = ()
    num_features: int = 0
    num_classes: int = 2
    loss: str = "logistic"

    @property
    def loss_history(self) -> list[float]:
        return [h.total for h in self.history]


def _penalty_value(norms: dict, reg: float, penalty: str) -> float:
    """Penalty from the norms aggregated over the new weight table."""
    if penalty == "none" or reg == 0.0:
        return 0.0
    if penalty == "l1":
        return reg * float(norms["l1"] or 0.0)
    return 0.5 * reg * float(norms["sq"] or 0.0)


def _written(weights: DataFrame) -> tuple[DataFrame, str]:
    """``weights`` as a Parquet table in the shared folder, and its path."""
    spark = weights.sparkSession
    path = scratch_path(spark, "wide-weights")
    weights.write.parquet(path)
    return spark.read.schema(weights.schema).parquet(path), path


def _written_with_norms(weights: DataFrame, *more: Column) -> tuple[DataFrame, str, dict]:
    """As :func:`_written`, with the norms (and ``more`` aggregates) of the rows as they are written."""
    seen = Observation()
    table, path = _written(weights.observe(seen, F.sum((F.col("w") - F.col("_old")) ** 2).alias("diff"), F.sum(F.col("w") ** 2).alias("sq"),
                                           F.sum(F.abs("w")).alias("l1"), *more))
    facts = seen.get
    return table, path, {k: (0.0 if v is None and k in ("diff", "sq", "l1") else v) for k, v in facts.items()}


def _names(outputs: int) -> list[str]:
    return ["idx"] if outputs == 1 else ["class", "idx"]


def _weight_side(weights: DataFrame, num_rows: int) -> DataFrame:
    side = weights.select(*[c for c in ("class", "idx", "w") if c in weights.columns])
    return F.broadcast(side) if num_rows <= BROADCAST_WEIGHTS_ROWS else side


def iteration_frames(ent: DataFrame, batch: DataFrame, weights: DataFrame, loss, num_features: int, bias: np.ndarray | None = None) -> DataFrame:
    """Per sampled key its loss and multiplier (``mult``, or the array ``mults`` of several margins)."""
    k = loss.outputs
    met = ent.join(_weight_side(weights, num_features * k), "idx")
    term = F.sum(F.col("value") * F.col("w"))
    if k == 1:
        margins = met.groupBy("key").agg(term.alias("z"))
        z = F.coalesce("z", F.lit(0.0))
        z = z if bias is None else z + F.lit(float(bias[0]))
    else:
        # the weight table holds every class of an index, so a key with entries has all margins
        margins = met.groupBy("key", "class").agg(term.alias("m")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("class", "m"))).alias("s"))
        margins = margins.select("key", F.transform("s", lambda e: e["m"]).alias("z"))
        z = F.coalesce("z", F.array_repeat(F.lit(0.0), k))
        if bias is not None:
            z = F.zip_with(z, F.array(*(F.lit(float(b)) for b in bias)), lambda a, b: a + b)
    per_key = batch.join(margins, "key", "left").select("key", "label", z.alias("z"))
    if k == 1:
        row_loss, mults = loss.columns([F.col("z")], F.col("label"))
        return per_key.select("key", row_loss.alias("loss"), mults[0].alias("mult"))
    if isinstance(loss, MultinomialLoss):
        row_loss, mults = loss.array_columns(F.col("z"), F.col("label"))
    else:
        row_loss, each = loss.columns([F.get("z", F.lit(c)) for c in range(k)], F.col("label"))
        mults = F.array(*each)
    return per_key.select("key", row_loss.alias("loss"), mults.alias("mults"))


def gradient_sums(ent: DataFrame, per_key: DataFrame) -> DataFrame:
    """Σ gradient ``g`` by index (and class) of the keys in ``per_key``."""
    if "mult" in per_key.columns:
        return (ent.join(per_key.select("key", "mult"), "key")
                .groupBy("idx").agg(F.sum(F.col("mult") * F.col("value")).alias("g")))
    terms = ent.join(per_key.select("key", "mults"), "key").select("idx", "value", F.posexplode("mults").alias("c", "m"))
    return terms.groupBy((F.col("c") + 1).alias("class"), "idx").agg(F.sum(F.col("m") * F.col("value")).alias("g"))


def gradient_by_index(ent: DataFrame, per_key: DataFrame, n: int) -> DataFrame:
    """Mean gradient ``(idx, g)`` of the ``n`` keys in ``per_key``."""
    sums = gradient_sums(ent, per_key)
    return sums.withColumn("g", F.col("g") / F.lit(float(n)))


def _totals(per_key: DataFrame, outputs: int) -> DataFrame:
    """One row: keys, loss sum and the sum of each multiplier."""
    mult = [F.col("mult")] if outputs == 1 else [F.get("mults", F.lit(c)) for c in range(outputs)]
    return per_key.agg(F.count(F.lit(1)).alias("_n"), F.sum("loss").alias("_ls"), *(F.sum(m).alias(f"_b{c}") for c, m in enumerate(mult)))


def fit_wide(entries: DataFrame, labels: DataFrame, config: TrainConfig | None = None, *,
             num_features: int | None = None, partitions: int | None = None,
             initial_weights: DataFrame | None = None, initial_intercepts=None, **overrides) -> WideFitResult:
    """Train on long-form features. ``entries``: ``key, idx, value``; ``labels``: ``key, label``.

    ``num_features`` defaults to the largest index plus one; an entry beyond a given one is
    an error. ``initial_weights`` is an ``(idx, weight)`` table, with a ``class`` column from 1 on for
    a loss of several margins (absent rows start at 0). A user rule is an
    :class:`~slopeline.operators.updates.UpdateRule`, whose state vectors become columns.
    The result's weight table lies in the shared checkpoint folder."""
    cfg = replace(config or TrainConfig(), **overrides) if overrides else (config or TrainConfig())
    loss = resolve_loss(cfg.loss, cfg.num_classes)
    walks = cfg.method in ("svrg", "svrg_avg")
    if cfg.update is not None and (walks or not isinstance(cfg.update, UpdateRule)):
        raise ValueError("wide mode applies a user rule to columns: give an UpdateRule, and a gradient method")
    if walks and not loss.has_numpy:
        raise ValueError(f"{cfg.method} walks rows in NumPy; the loss needs a numpy form")
    spark = entries.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ent = (entries.select("key", F.col("idx").cast("int").alias("idx"), F.col("value").cast("double").alias("value"))
           .repartition(parts, "key").persist(StorageLevel.MEMORY_AND_DISK))
    lab = (labels.select("key", F.col("label").cast("double").alias("label"))
           .repartition(parts, "key").persist(StorageLevel.MEMORY_AND_DISK))
    try:
        num_features = _check_wide_input(ent, lab, loss, cfg, num_features)
        weights, path, bias, norms = _start(spark, cfg, loss, num_features, initial_weights, initial_intercepts)
        result = WideFitResult(weights, num_features=num_features, num_classes=getattr(loss, "num_classes", 2), loss=loss.name)
        fitted = _Fit(ent, lab, cfg, loss, num_features, weights, path, bias, result)
        fitted.reg_val = _penalty_value(fitted.with_bias(norms), fitted.reg, fitted.shown) if initial_weights is not None or initial_intercepts is not None else 0.0
        (fitted.walk if walks else fitted.descend)()
        names = _names(loss.outputs)
        result.weights = fitted.weights.select(*names, F.col("w").alias("weight"))
        result.intercepts = tuple(float(b) for b in fitted.bias) if cfg.intercept else ()
        return result
    finally:
        ent.unpersist()
        lab.unpersist()


def _start(spark, cfg: TrainConfig, loss, num_features: int, initial: DataFrame | None, intercepts):
    """The written first weight table, its path, the intercepts and the norms."""
    names = _names(loss.outputs)
    start = spark.range(num_features).select(F.col("id").cast("int").alias("idx"))
    if loss.outputs > 1:
        start = start.select(F.explode(F.sequence(F.lit(1), F.lit(loss.outputs))).alias("class"), "idx")
    if initial is None:
        start = start.withColumn("w", F.lit(0.0))
    else:
        given = initial.select(*(F.col(c).cast("int").alias(c) for c in names), F.col("weight").cast("double").alias("w"))
        _check_indices(given, num_features, "initial weights")
        start = start.join(given, names, "left").select(*names, F.coalesce("w", F.lit(0.0)).alias("w"))
    state = _state_names(cfg)
    bias = np.zeros(loss.outputs) if intercepts is None else np.array(intercepts, np.float64)
    if len(bias) != loss.outputs:
        raise ValueError(f"initial intercepts need {loss.outputs} entries, got {len(bias)}")
    return (*(r := _written_with_norms(start.select(*names, "w", F.lit(0.0).alias("_old"), *[F.lit(0.0).alias(c) for c in state])))[:2], bias, r[2])


def _state_names(cfg: TrainConfig) -> tuple:
    if cfg.update is not None:
        return tuple(cfg.update.state)
    return STATE.get(cfg.method, ())


class _Fit:
    """One run: the present weight table, the intercepts and the history."""

    def __init__(self, ent, lab, cfg, loss, num_features, weights, path, bias, result):
        self.ent, self.lab, self.cfg, self.loss, self.d = ent, lab, cfg, loss, num_features
        self.weights, self.path, self.bias, self.result = weights, path, bias, result
        self.reg, self.shown = cfg.effective_reg(), reg_penalty(cfg.method, cfg.penalty)
        self.names, self.reg_val, self.updates = _names(loss.outputs), 0.0, 0
        self.bias_reg = self.reg if cfg.penalise_bias else 0.0
        self.bias_state = {c: bias * 0.0 for c in _state_names(cfg)}

    def with_bias(self, norms: dict, old: np.ndarray | None = None) -> dict:
        """Norms of table and intercepts together; an unpenalised intercept counts for convergence only."""
        b = self.bias if self.cfg.intercept else np.zeros(0)
        moved = 0.0 if old is None or not len(b) else float(((b - old) ** 2).sum())
        paid = b if self.cfg.penalise_bias else b * 0.0
        return {"diff": math.sqrt(norms["diff"] + moved), "size": math.sqrt(norms["sq"] + float((b * b).sum())),
                "sq": norms["sq"] + float((paid * paid).sum()), "l1": norms["l1"] + float(np.abs(paid).sum())}

    def replaced(self, table: DataFrame, path: str, norms: dict, bias: np.ndarray) -> bool:
        """Take over new weights; whether they have converged."""
        remove_path(table.sparkSession, self.path)
        old, self.weights, self.path, self.bias = self.bias, table, path, bias
        self.updates += 1
        self.result.updates = self.updates
        total = self.with_bias(norms, old)
        self.reg_val = _penalty_value(total, self.reg, self.shown)
        self.result.converged = self.updates >= 2 and total["diff"] < self.cfg.tol * max(total["size"], 1.0)
        return self.result.converged

    def margin_bias(self):
        return self.bias if self.cfg.intercept else None

    def rule(self, i: int):
        """The update as a function of weights, gradient, state, penalty weight and kind of operand."""
        cfg = self.cfg

        def run(w, g, state, reg, ops=None):
            ctx = StepContext(i=i, t=self.updates, step=cfg.step, reg=reg, penalty=cfg.penalty, variant=cfg.variant)
            more = {"ops": ops} if ops else {}
            if cfg.update is not None:
                return cfg.update(w, g, state, ctx, **more)
            return apply_rule(cfg.method, w, g, state, ctx, **more)

        return run

    def descend(self) -> None:
        cfg, k, result = self.cfg, self.loss.outputs, self.result
        keep_history, state_cols = records_history(cfg.method, cfg.variant), _state_names(cfg)
        for i in range(1, cfg.iters + 1):
            result.iterations = i
            batch = keyed_sample(self.lab, "key", cfg.fraction, cfg.seed + i, cfg.sampler)
            per_key = iteration_frames(self.ent, batch, self.weights, self.loss, self.d, self.margin_bias()).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                totals = _totals(per_key, k)  # one row
                joined = self.weights.join(gradient_sums(self.ent, per_key), self.names, "left").crossJoin(F.broadcast(totals))
                joined = joined.select(*self.names, "w", *state_cols, "_n", "_ls", *(f"_b{c}" for c in range(k)),
                                       (F.coalesce("g", F.lit(0.0)) / F.greatest("_n", F.lit(1)).cast("double")).alias("g"))
                rule = self.rule(i)
                new_w, new_state = rule(F.col("w"), F.col("g"), {c: F.col(c) for c in state_cols}, self.reg, ColumnOps)
                table = joined.select(*self.names, new_w.alias("w"), F.col("w").alias("_old"), *[new_state[c].alias(c) for c in state_cols], "_n", "_ls", *(f"_b{c}" for c in range(k)))
                kept = [*self.names, "w", "_old", *state_cols]
                table, path, facts = self._write(table, kept)
            finally:
                per_key.unpersist()
            n = int(facts["n"] or 0)
            if n == 0:
                remove_path(self.weights.sparkSession, path)
                warnings.warn(f"iteration {i}/{cfg.iters}: the sampled batch is empty", stacklevel=3)
                continue
            if keep_history:
                result.history.append(HistoryEntry(i, float(facts["ls"]) / n, self.reg_val, n))
            bias = self.bias
            if cfg.intercept:
                g = np.array([facts[f"b{c}"] for c in range(k)], np.float64) / n
                bias, self.bias_state = rule(self.bias, g, self.bias_state, self.bias_reg)
            if self.replaced(table, path, facts, bias):
                break

    def _write(self, table: DataFrame, kept: list[str]) -> tuple[DataFrame, str, dict]:
        """Write the new weights, observing norms and the batch's totals in the same job."""
        seen, path = Observation(), scratch_path(table.sparkSession, "wide-weights")
        totals = [F.max(c).alias(c[1:]) for c in table.columns if c in ("_n", "_ls") or c.startswith("_b")]
        observed = table.observe(seen, F.sum((F.col("w") - F.col("_old")) ** 2).alias("diff"), F.sum(F.col("w") ** 2).alias("sq"), F.sum(F.abs("w")).alias("l1"), *totals)
        out = observed.select(*kept)
        out.write.parquet(path)
        facts = {k: (0.0 if v is None else v) for k, v in seen.get.items()}
        return table.sparkSession.read.schema(out.schema).parquet(path), path, facts

    # -- variance-reduced walks ------------------------------------------------------------

    def walk(self) -> None:
        from slopeline.operators.svrg import _walk_order

        cfg, loss, result, d, k = self.cfg, self.loss, self.result, self.d, self.loss.outputs
        by = F.pmod(F.col("key"), F.lit(cfg.shards)) if cfg.shard_by == "key_mod" else F.pmod(F.xxhash64("key"), F.lit(cfg.shards))
        packed = self.ent.groupBy("key").agg(F.collect_list(F.struct("idx", "value")).alias("e"))
        e = F.coalesce("e", F.array().cast("array<struct<idx:int,value:double>>"))
        rows = self.lab.join(packed, "key", "left").select("key", "label", F.struct(F.transform(e, lambda x: x["idx"]).alias("indices"), F.transform(e, lambda x: x["value"]).alias("values")).alias("features"))
        rows = rows.withColumn("shard", by.cast("int")).repartitionById(cfg.shards, "shard").persist(StorageLevel.MEMORY_AND_DISK)
        held = rows.select(F.col("shard").alias("held_by"), F.explode("features.indices").alias("idx")).distinct().persist(StorageLevel.MEMORY_AND_DISK)
        try:
            entries = rows.agg(F.sum(F.size("features.indices"))).first()[0] or 0
            if entries * 12 * cfg.fraction > cfg.shards * cfg.max_shard_bytes:
                raise ValueError(f"{cfg.shards} shards of {cfg.max_shard_bytes} bytes are too few for {entries} entries; "
                                 f"set shards to at least {math.ceil(entries * 12 * cfg.fraction / cfg.max_shard_bytes)}")
            for i in range(1, cfg.iters + 1):
                result.iterations = i
                eta, bias = cfg.step / math.sqrt(i), self.bias
                needed = held.join(_weight_side(self.weights, d * k), "idx")
                mean = mean_rows = None
                mu_bias = np.zeros(k)
                if cfg.method == "svrg_avg":
                    batch = keyed_sample(self.lab, "key", cfg.mean_fraction, cfg.seed + i, cfg.sampler)
                    per_key = iteration_frames(self.ent, batch, self.weights, loss, d, self.margin_bias()).persist(StorageLevel.MEMORY_AND_DISK)
                    totals = _totals(per_key, k).first()
                    mean_rows = int(totals["_n"])
                    if not mean_rows:
                        per_key.unpersist()
                        warnings.warn(f"iteration {i}/{cfg.iters}: the sample for the mean gradient is empty", stacklevel=3)
                        continue
                    mu_bias = np.array([totals[f"_b{c}"] for c in range(k)]) / mean_rows
                    mean = gradient_by_index(self.ent, per_key, mean_rows).persist(StorageLevel.MEMORY_AND_DISK)
                    needed = needed.join(mean, self.names, "left").withColumn("mu", F.coalesce("g", F.lit(0.0)))
                order_of = lambda n, shard, i=i: _walk_order(n, cfg.order, cfg.seed, i, shard, cfg.method == "svrg")
                kernel = _shard_kernel(cfg, loss, d, eta, self.reg, self.bias_reg, bias, mu_bias, order_of)
                sampled = keyed_sample(rows, "key", cfg.fraction, cfg.seed + i, cfg.sampler)
                moved = sampled.groupBy("shard").cogroup(needed.groupBy("held_by")).applyInArrow(kernel, MOVED).persist(StorageLevel.MEMORY_AND_DISK)
                try:
                    scalars = {(r["idx"], r["class"]): r["v"] for r in moved.filter("idx < 0").groupBy("idx", "class").agg(F.sum("value").alias("v")).collect()}
                    total = lambda s: float(scalars.get((-1 - s, 0), 0.0))
                    n, used = int(total(lazy_walks.ROWS)), int(total(lazy_walks.USED))
                    if n == 0:
                        warnings.warn(f"iteration {i}/{cfg.iters}: the sampled batch is empty", stacklevel=3)
                        continue
                    sums = moved.filter("idx >= 0").groupBy(*([F.col("class")] if k > 1 else []), "idx").agg(F.sum("value").alias("moved"))
                    joined = self.weights.join(sums, self.names, "left").withColumn("moved", F.coalesce("moved", F.lit(0.0)))
                    pushed = np.array([scalars.get((BIAS, c), 0.0) for c in range(k)])
                    if cfg.method == "svrg":
                        new_w = penalised_step(F.col("w"), F.col("moved") / F.lit(float(n)), eta, self.reg, cfg.penalty, ColumnOps)
                        new_bias = penalised_step(bias, pushed / n, eta, self.bias_reg, cfg.penalty)
                        denom = n
                    else:
                        observed = cfg.variant == "observed"
                        count = float(cfg.shards if observed else used)
                        denom = mean_rows if observed else n
                        joined = joined.join(mean.withColumnRenamed("g", "mu"), self.names, "left").withColumn("mu", F.coalesce("mu", F.lit(0.0)))
                        rest = float(cfg.shards - used) if observed else 0.0
                        keep, gain = total(lazy_walks.KEPT) + rest, total(lazy_walks.SUMS)
                        new_w = (F.lit(keep) * F.col("w") - F.lit(eta * gain) * F.col("mu") + F.col("moved")) / F.lit(count)
                        free = self.bias_reg == 0.0
                        new_bias = (((used if free else total(lazy_walks.KEPT)) + rest) * bias - eta * (n if free else gain) * mu_bias + pushed) / count
                    table, path, facts = self._write(joined.select(*self.names, new_w.alias("w"), F.col("w").alias("_old")), [*self.names, "w", "_old"])
                finally:
                    moved.unpersist()
                    if mean is not None:
                        mean.unpersist()
                        per_key.unpersist()
                result.history.append(HistoryEntry(i, total(lazy_walks.LOSS) / denom, self.reg_val, n))
                if self.replaced(table, path, facts, new_bias if cfg.intercept else bias):
                    break
        finally:
            held.unpersist()
            rows.unpersist()


#: Rows of a shard's answer: values by class and index; scalars at -1 - s, intercepts at BIAS.
MOVED = "class int, idx int, value double"
BIAS = -100


def _shard_kernel(cfg: TrainConfig, loss, d: int, eta: float, reg: float, bias_reg: float, bias: np.ndarray, mu_bias: np.ndarray, order_of):
    """Cogrouped kernel of one shard: its rows, and the weights (and mean gradient) it holds. With an
    intercept every row has one more entry of 1, at the last local index."""
    k, avg, with_bias = loss.outputs, cfg.method == "svrg_avg", cfg.intercept

    def kernel(rows: pa.Table, needed: pa.Table) -> pa.Table:
        empty = {"class": pa.array([], pa.int32()), "idx": pa.array([], pa.int32()), "value": pa.array([], pa.float64())}
        if not rows.num_rows:
            return pa.table(empty)
        shard, rows = rows.column("shard")[0].as_py(), rows.sort_by([("key", "ascending")])
        x, y = SparseRows(rows.column("features").combine_chunks(), d), label_vector(rows.column("label"))
        local = np.unique(x.idx)
        at = needed.column("idx").to_numpy()
        row_of = needed.column("class").to_numpy() - 1 if k > 1 else np.zeros(len(at), np.int64)
        place = np.searchsorted(local, at)
        here = place < len(local)
        here[here] = local[place[here]] == at[here]

        def spread(name: str, extra: np.ndarray) -> np.ndarray:
            out = np.zeros((k, len(local) + with_bias))
            out[row_of[here], place[here]] = needed.column(name).to_numpy()[here]
            if with_bias:
                out[:, -1] = extra
            return out

        w, names = spread("w", bias), local
        if with_bias:  # the intercept's entry goes behind all others
            x.row, x.idx, x.val = np.concatenate([x.row, np.arange(x.n)]), np.concatenate([x.idx, np.full(x.n, d)]), np.concatenate([x.val, np.ones(x.n)])
            order = np.argsort(x.row, kind="stable")
            x.row, x.idx, x.val = x.row[order], x.idx[order], x.val[order]
            names = np.append(local, d)
        rate = np.full(len(names), eta * reg)
        if with_bias:
            rate[-1] = eta * bias_reg
        order = order_of(x.n, shard)
        if avg:
            moved, met = lazy_walks.svrg_avg_shard(x, names, w, spread("mu", mu_bias), y, order, loss, eta, rate)
        else:
            moved, met = lazy_walks.svrg_shard(x, names, w, y, order, loss, eta, rate)
        scalars = lazy_walks.shard_scalars(met, x.n, eta, reg)
        classes = np.repeat(np.arange(1, k + 1) if k > 1 else [0], len(local))
        cols = [np.concatenate([classes, np.zeros(len(scalars)), np.arange(k) if with_bias else np.zeros(0)]), np.concatenate([np.tile(local, k), -1 - np.array(list(scalars)), np.full(k if with_bias else 0, BIAS)]),
                np.concatenate([moved[:, : len(local)].ravel(), list(scalars.values()), moved[:, -1] if with_bias else np.zeros(0)])]
        return pa.table({name: pa.array(c.astype(t)) for name, c, t in zip(empty, cols, (np.int32, np.int32, np.float64))})

    return kernel


def _check_indices(df: DataFrame, num_features: int | None, what: str) -> int:
    """The width of ``df`` after checks: no null or negative index, none beyond ``num_features``."""
    values = [c for c in ("value", "w") if c in df.columns]
    null = F.col("idx").isNull()
    for c in values:
        null = null | F.col(c).isNull()
    f = df.agg(F.max("idx").alias("top"), F.min("idx").alias("low"), F.sum(F.when(null, 1).otherwise(0)).alias("nulls")).collect()[0]
    if f["nulls"]:
        raise ValueError(f"{f['nulls']} {what} have a null index or value")
    if f["low"] is not None and f["low"] < 0:
        raise ValueError(f"indices of {what} must be non-negative")
    width = int((f["top"] if f["top"] is not None else -1) + 1)
    if num_features is not None and width > num_features:
        raise ValueError(f"{what} have index {width - 1}, beyond num_features={num_features}")
    return width if num_features is None else num_features


def _check_wide_input(ent: DataFrame, lab: DataFrame, loss, cfg: TrainConfig, num_features: int | None) -> int:
    """Check labels (one valid row a key) and entries; the number of features."""
    # the labels are already hash-partitioned by key, so the grouping needs no further shuffle
    y = F.col("label")
    bad = y.isNotNull() & ~label_is_valid(y, loss, getattr(loss, "num_classes", cfg.num_classes))
    facts = (lab.groupBy("key").agg(F.count(F.lit(1)).alias("c"),
                                     F.sum(F.when(y.isNull(), 1).otherwise(0)).alias("nulls"),
                                     F.sum(F.when(bad, 1).otherwise(0)).alias("bad"))
             .agg(F.max("c").alias("c"), F.sum("nulls").alias("nulls"), F.sum("bad").alias("bad"),
                  F.sum(F.when(F.col("key").isNull(), 1).otherwise(0)).alias("no_key"))
             .collect()[0])
    if facts["no_key"]:
        raise ValueError("wide mode needs a key on every label row")
    if (facts["c"] or 0) > 1:
        raise ValueError("wide mode needs one label row per key")
    if facts["nulls"]:
        raise ValueError(f"{facts['nulls']} rows have a null label")
    if facts["bad"] and cfg.validate:
        raise ValueError(f"{facts['bad']} labels are not valid for the loss {loss.name}" if loss.outputs > 1 else f"{facts['bad']} labels are not 0 or 1")
    return _check_indices(ent, num_features, "feature entries")


def predict_wide(entries: DataFrame, weights: DataFrame, *, keys: DataFrame | None = None, intercept=0.0,
                 threshold: float | None = 0.5, num_features: int | None = None,
                 output: str = "prediction", kind: str = "logistic") -> DataFrame:
    """Score long-form features with a weight table ``(idx, weight)`` or ``(class, idx, weight)``.

    ``margin = Σ value * weight`` by key (+ ``intercept``, a sequence for several classes); an entry
    whose index has no weight counts 0, so every key of ``entries`` has a row. The output is the
    class at ``threshold`` (strictly greater) or, with ``threshold=None``, the score: a probability for
    the ``kind`` ``logistic``, else the margin. With several
    classes the output is the one of the largest margin, the lowest of equals, or 0 when none is above 0.
    ``keys`` (a frame with a ``key`` column) adds rows with no entries, scored at margin 0. The weight
    table is broadcast only when ``num_features`` is given and under the row bound, and its
    indices are then checked to lie below it.
    """
    many = "class" in weights.columns
    w = weights.select(*([F.col("class").cast("int").alias("_class")] if many else []), F.col("idx").cast("int").alias("idx"), F.col("weight").alias("_w"))
    if num_features is not None and num_features <= BROADCAST_WEIGHTS_ROWS:
        rows = weights.agg(F.max("idx").alias("top"), F.count(F.lit(1)).alias("n"), (F.max("class") if many else F.lit(1)).alias("classes")).collect()[0]
        if (rows["top"] or 0) >= num_features or rows["n"] > num_features * (rows["classes"] or 1):
            raise ValueError(f"the weight table is larger than num_features={num_features}")
        w = F.broadcast(w) if rows["n"] <= BROADCAST_WEIGHTS_ROWS else w
    met = entries.join(w, "idx", "left")
    term = F.sum(F.col("value") * F.coalesce("_w", F.lit(0.0)))
    if many:
        z = met.groupBy("key", "_class").agg(term.alias("_m")).groupBy("key").agg(F.collect_list(F.struct("_class", "_m")).alias("_z"))
    else:
        z = met.groupBy("key").agg(term.alias("_z"))
    if keys is not None:
        every = keys.select("key").unionByName(z.select("key")).distinct()
        z = every.join(z.withColumnRenamed("key", "_k"), F.col("key").eqNullSafe(F.col("_k")), "left").select("key", "_z")
    if many:
        return z.select("key", _largest_class(F.col("_z"), intercept).alias(output))
    margin = F.coalesce("_z", F.lit(0.0)) + F.lit(float(np.ravel(intercept)[0] if np.size(intercept) else 0.0))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)) if kind in ("logistic", "multinomial") else margin
    col = score if threshold is None else F.when(score > F.lit(float(threshold)), 1.0).otherwise(0.0)
    return z.select("key", col.alias(output))


def _largest_class(pairs: Column, intercept) -> Column:
    """The class of the largest margin above 0 from (class, margin) pairs; classes without a pair have their
    intercept as margin."""
    bias = [float(b) for b in np.ravel(intercept)]
    if len(bias) > 1 or any(bias):
        by = F.map_from_entries(F.filter(F.coalesce(pairs, F.array().cast("array<struct<_class:int,_m:double>>")), lambda p: p["_class"].isNotNull()))
        pairs = F.array(*(F.struct(F.lit(c).alias("_class"), (F.coalesce(F.try_element_at(by, F.lit(c)), F.lit(0.0)) + F.lit(b)).alias("_m")) for c, b in enumerate(bias, 1)))
    above = F.filter(F.coalesce(pairs, F.array().cast("array<struct<_class:int,_m:double>>")), lambda p: p["_m"] > 0.0)
    # of equal margins the lowest class: largest (margin, -class)
    best = F.array_max(F.transform(above, lambda p: F.struct(p["_m"].alias("m"), (-p["_class"]).alias("c"))))
    return F.coalesce(-best["c"], F.lit(0)).cast("double")
