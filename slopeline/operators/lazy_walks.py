"""Variance-reduced shard walks over sparse rows, and walks of shards beyond memory.

A step of a walk moves every weight: ``w <- (1 - eta reg) w - eta (c x_r + mu)``. Only the first
part of the bracket depends on the row, and it is zero outside the row's entries. A weight that no
row has read for ``m`` steps has moved by ``m`` steps with ``c x = 0``, which is

    ``w <- a^m w - eta S_m mu``   with ``a = 1 - eta reg`` and ``S_m = 1 + a + ... + a^(m-1)``.

So each weight carries the step it was last brought up to date, a step touches the entries of its
row alone, and its cost is one row's non-zeros. What a shard returns is sparse too:

* gradient aggregating (``svrg``): the sum of ``f`` is zero outside the shard's entries;
* weight averaging (``svrg_avg``): a weight that the shard's rows never touch ends at
  ``a^n w - eta S_n mu``, which needs no more than the shard's row count. A shard returns, for each
  touched weight, how far it ends from there; the mean over shards is put together from the sums of
  these distances and of ``a^n`` and ``S_n``.

Streamed walks take the rows of a shard as Arrow batches in the order of the walk, which Spark
sorts (and spills) by the draws of the walk. The gradient aggregating walk needs its shard's mean gradient first, and
draws rows with replacement: the shard is sent twice, first as it is, then joined to its draws.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeline.functions.losses import MarginLoss
from slopeline.operators.gradient import DIRECT_MERGE_LIMIT, SLOT_SCHEMA, SparseRows, feature_rows, label_vector, merge_slots

#: Scalars that a shard returns after its slots: losses, shards with rows, rows, sums of a^n and S_n.
LOSS, USED, ROWS, KEPT, SUMS = range(5)
SCALARS = 5
TWO_32 = 4294967296.0


def decay(steps, rate):
    """``a^m`` and ``S_m`` for ``m`` idle steps with ``a = 1 - rate`` (arrays or scalars)."""
    steps, rate = np.broadcast_arrays(np.asarray(steps, np.float64), np.asarray(rate, np.float64))
    kept = np.power(1.0 - rate, steps)
    small = (rate > 0) & (rate < 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        exact = -np.expm1(steps * np.log1p(-np.where(small, rate, 0.5))) / np.where(small, rate, 0.5)
        sums = np.where(rate == 0, steps, np.where(small, exact, (1.0 - kept) / np.where(rate == 0, 1.0, rate)))
    return kept, sums


class LazyWeights:
    """The weights (k, t) of a walk; ``mu`` the mean gradient, ``rate`` is eta * reg, a scalar or by weight."""

    def __init__(self, w: np.ndarray, mu: np.ndarray, eta: float, rate):
        self.w, self.mu, self.eta = w.astype(np.float64, copy=True), mu, eta
        self.rate = np.full(w.shape[1], rate) if not np.ndim(rate) else np.asarray(rate, np.float64)
        self.stamp, self.done = np.zeros(w.shape[1], np.int64), 0

    def read(self, idx) -> np.ndarray:
        """The weights at ``idx``, brought up to the present step."""
        late = self.done - self.stamp[idx]
        if late.any():
            kept, sums = decay(late, self.rate[idx])
            self.w[:, idx] = kept * self.w[:, idx] - self.eta * sums * self.mu[:, idx]
            self.stamp[idx] = self.done
        return self.w[:, idx]

    def step(self, idx, push: np.ndarray) -> None:
        """One step whose row pushes ``push`` (k, entries) at ``idx``, just read."""
        self.w[:, idx] = (1.0 - self.rate[idx]) * self.w[:, idx] - self.eta * (push + self.mu[:, idx])
        self.done += 1
        self.stamp[idx] = self.done

    def finish(self) -> np.ndarray:
        return self.read(slice(None))


class WalkRows:
    """Rows of a walk as index and value slices; entries of a row with one index are added up."""

    def __init__(self, rows, local: np.ndarray | None = None):
        self.dense = not isinstance(rows, SparseRows)
        if self.dense:
            self.x, self.n = rows.x, len(rows.x)
            return
        self.n = rows.n
        idx = rows.idx if local is None else np.searchsorted(local, rows.idx)
        width = int(idx.max()) + 1 if len(idx) else 1
        keys, where = np.unique(rows.row * np.int64(width) + idx, return_inverse=True)
        self.val = np.bincount(where, weights=rows.val, minlength=len(keys)) if len(keys) else np.zeros(0)
        self.idx, row = keys % width, keys // width
        self.first = np.searchsorted(row, np.arange(self.n + 1))

    def row(self, r: int):
        if self.dense:
            return slice(None), self.x[r]
        lo, hi = self.first[r], self.first[r + 1]
        return self.idx[lo:hi], self.val[lo:hi]


def _margin_step(loss: MarginLoss, z: np.ndarray, y: float) -> tuple[float, np.ndarray]:
    if loss.outputs == 1:
        value, mult = loss.scalar(float(z[0]), y)
        return value, np.array([mult])
    value, mult = loss.numpy(z[None, :], np.array([y]))
    return float(value[0]), mult[0]


def walk(rows: WalkRows, y: np.ndarray, mult0: np.ndarray, order, state: LazyWeights, loss: MarginLoss, total: np.ndarray | None = None) -> float:
    """Steps over ``rows`` in ``order``; adds the rows' part of ``f`` to ``total`` if given and returns the
    sum of the losses met on the way."""
    met = 0.0
    for r in order:
        idx, val = rows.row(r)
        value, mult = _margin_step(loss, state.read(idx) @ val, float(y[r]))
        push = (mult - mult0[r])[:, None] * val
        if total is not None:
            total[:, idx] += push
        state.step(idx, push)
        met += value
    return met


def svrg_shard(rows: SparseRows, local: np.ndarray, w: np.ndarray, y: np.ndarray, order: np.ndarray, loss: MarginLoss, eta: float, rate):
    """Sum of ``f`` (k, touched) and of the losses of one shard; ``w`` at the touched indices ``local``."""
    steps = WalkRows(rows, local)
    here = _Local(steps, len(local))
    _, mult0 = loss.numpy(here.margins(w), y)
    mu = here.gradient(mult0) / steps.n
    total = np.zeros_like(w)
    met = walk(steps, y, mult0, order, LazyWeights(w, mu, eta, rate), loss, total)
    return total + len(order) * mu, met


def svrg_avg_shard(rows: SparseRows, local: np.ndarray, w: np.ndarray, mu: np.ndarray, y: np.ndarray, order: np.ndarray, loss: MarginLoss, eta: float, rate):
    """How far each touched weight ends from an untouched one, and the sum of the losses at ``w``."""
    steps = WalkRows(rows, local)
    loss0, mult0 = loss.numpy(_Local(steps, len(local)).margins(w), y)
    state = LazyWeights(w, mu, eta, rate)
    walk(steps, y, mult0, order, state, loss)
    return state.finish() - idle(w, mu, eta, rate, steps.n), float(loss0.sum())


def idle(w, mu, eta: float, rate, steps: int) -> np.ndarray:
    """Weights after ``steps`` steps that touch none of them."""
    kept, sums = decay(steps, rate)
    return kept * w - eta * sums * mu


class _Local:
    """Margins and gradients of walk rows over their local indices."""

    def __init__(self, rows: WalkRows, width: int):
        self.rows, self.width = rows, width
        self.owner = np.repeat(np.arange(rows.n), np.diff(rows.first))

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.owner, weights=self.rows.val * c[self.rows.idx], minlength=self.rows.n) for c in w], axis=1)

    def gradient(self, mult: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.rows.idx, weights=self.rows.val * m[self.owner], minlength=self.width) for m in mult.T])


def sparse_slots(touched: np.ndarray, values: np.ndarray, d: int, scalars: dict, n: int) -> pa.RecordBatch:
    """Long form of a shard's touched slots (class-major) and its scalars behind all slots."""
    k = len(values)
    slots = (np.arange(k)[:, None] * d + touched).ravel()
    tail = k * d + np.array(list(scalars))
    slot = np.concatenate([slots, tail]).astype(np.int32)
    value = np.concatenate([values.ravel(), list(scalars.values())])
    return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(value), pa.array(np.full(len(slot), n, np.int64))], names=["slot", "value", "n"])


def shard_scalars(loss_sum: float, n: int, eta: float, reg: float) -> dict:
    kept, sums = decay(n, eta * reg)
    return {LOSS: loss_sum, USED: 1.0, ROWS: float(n), KEPT: float(kept), SUMS: float(sums)}


def reduce_slots(partials: DataFrame, slots: int, expected: int) -> tuple[np.ndarray, np.ndarray]:
    """Summed slots and scalars of all shards; merged by slot in a shuffle first when there are many."""
    if expected > DIRECT_MERGE_LIMIT:
        partials = merge_slots(partials)
    t = partials.toArrow()
    acc = np.bincount(t.column("slot").to_numpy(), weights=t.column("value").to_numpy(), minlength=slots + SCALARS)
    return acc[:slots], acc[slots:]


def averaged(w: np.ndarray, mu: np.ndarray, moved: np.ndarray, scalars: np.ndarray, eta: float, reg, used: float):
    """Mean of the shards' end weights from the sums of their distances (see the module text); ``reg``
    may be 0 at some slots."""
    free = np.asarray(reg) == 0.0
    kept = np.where(free, scalars[USED], scalars[KEPT])
    sums = np.where(free, scalars[ROWS], scalars[SUMS])
    return (kept * w - eta * sums * mu + moved) / used


# -- walks in memory over sparse rows, weights in the task closure ----------------------------


def sparse_svrg_kernel(w, loss: MarginLoss, d: int, eta: float, reg, order_of):
    """``order_of(n, shard)`` gives the rows of the steps. Emits touched slots and scalars."""
    w0 = np.asarray(w, np.float64).reshape(loss.outputs, d)

    def kernel(table: pa.Table) -> pa.Table:
        from slopeline.operators.svrg import _ordered

        shard, table = table.column("shard")[0].as_py(), _ordered(table)
        rows, y = feature_rows(table.column("features"), d), label_vector(table.column("label"))
        touched = np.unique(rows.idx)
        total, met = svrg_shard(rows, touched, w0[:, touched], y, order_of(len(y), shard), loss, eta, _rate(eta, reg, touched))
        return pa.Table.from_batches([sparse_slots(touched, total, d, shard_scalars(met, len(y), eta, _scalar(reg)), len(y))])

    return kernel


def sparse_svrg_avg_kernel(w, mu, loss: MarginLoss, d: int, eta: float, reg, order_of):
    w0, mean = (np.asarray(v, np.float64).reshape(loss.outputs, d) for v in (w, mu))

    def kernel(table: pa.Table) -> pa.Table:
        from slopeline.operators.svrg import _ordered

        shard, table = table.column("shard")[0].as_py(), _ordered(table)
        rows, y = feature_rows(table.column("features"), d), label_vector(table.column("label"))
        touched = np.unique(rows.idx)
        moved, loss_sum = svrg_avg_shard(rows, touched, w0[:, touched], mean[:, touched], y, order_of(len(y), shard), loss, eta, _rate(eta, reg, touched))
        return pa.Table.from_batches([sparse_slots(touched, moved, d, shard_scalars(loss_sum, len(y), eta, _scalar(reg)), len(y))])

    return kernel


def _rate(eta: float, reg, touched=None):
    """eta * reg, by weight where ``reg`` is given by slot (the same for every class)."""
    if not np.ndim(reg):
        return eta * reg
    one = np.atleast_2d(reg)[0]
    return eta * (one if touched is None else one[touched])


def _scalar(reg) -> float:
    return float(np.max(reg)) if np.ndim(reg) else float(reg)


# -- streamed walks ------------------------------------------------------------------------------


def drawn(batch: DataFrame, i: int, seed: int) -> DataFrame:
    """Rows of the batch with their place in the shard (in key order) and the draw of the step of
    that number, the md5 draw of :func:`slopeline.operators.svrg.draw` as columns."""
    from pyspark.sql import Window

    keys = ["key"] + (["_rid"] if "_rid" in batch.columns else [])
    place = F.row_number().over(Window.partitionBy("shard").orderBy(*keys)) - 1
    rows = batch.withColumn("place", place.cast("long"))
    text = F.concat(F.lit(f"{i}:"), F.col("shard").cast("string"), F.lit(":"), F.col("place").cast("string"), F.lit(f":{seed}"))
    return rows.withColumn("draw", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long").cast("double") / F.lit(TWO_32))


def in_walk_order(batch: DataFrame, shards: int, i: int, seed: int, order: str) -> DataFrame:
    """Rows of each shard in the order of a walk without replacement."""
    rows = drawn(batch, i, seed)
    at = ["draw", "place"] if order == "random" else ["place"]
    return rows.select("shard", "label", "features", *at).repartitionById(shards, "shard").sortWithinPartitions("shard", *at)


def twice_in_order(batch: DataFrame, shards: int, i: int, seed: int, order: str) -> DataFrame:
    """Rows of each shard as they are (``phase`` 0), then the rows of its steps in order (1)."""
    rows = drawn(batch, i, seed)
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))  # one row a shard
    steps = rows.select("shard", "place", "draw").join(F.broadcast(sizes), "shard")
    pick = F.floor(F.col("draw") * F.col("size")) if order == "random" else F.col("place")
    steps = steps.select(F.col("shard").alias("s"), F.col("place").alias("step"), pick.cast("long").alias("pick"))
    met = rows.join(steps, (F.col("shard") == F.col("s")) & (F.col("place") == F.col("pick"))).select("shard", F.lit(1).alias("phase"), "step", "label", "features")
    first = rows.select("shard", F.lit(0).alias("phase"), F.col("place").alias("step"), "label", "features")
    return first.unionByName(met).repartitionById(shards, "shard").sortWithinPartitions("shard", "phase", "step")


def streamed_svrg_avg(w, mu, loss: MarginLoss, d: int, eta: float, reg):
    """Streamed kernel of the weight averaging walk: holds the weights and one batch."""
    w0, mean = (np.asarray(v, np.float64).reshape(loss.outputs, d) for v in (w, mu))
    rate, plain = _rate(eta, reg), _scalar(reg)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, loss_sum, n = LazyWeights(w0, mean, eta, rate), 0.0, 0
        touched = np.zeros(d, bool)
        for b in batches:
            rows, y = feature_rows(b.column("features"), d), label_vector(b.column("label"))
            loss0, mult0 = loss.numpy(rows.margins(w0), y)
            steps = WalkRows(rows)
            touched[slice(None) if steps.dense else steps.idx] = True
            walk(steps, y, mult0, range(steps.n), state, loss)
            loss_sum, n = loss_sum + float(loss0.sum()), n + steps.n
        if n:
            at = np.flatnonzero(touched)
            moved = (state.finish() - idle(w0, mean, eta, rate, n))[:, at]
            yield sparse_slots(at, moved, d, shard_scalars(loss_sum, n, eta, plain), n)

    return kernel


def streamed_svrg(w, loss: MarginLoss, d: int, eta: float, reg):
    """Streamed kernel of the gradient aggregating walk over rows of both phases."""
    w0 = np.asarray(w, np.float64).reshape(loss.outputs, d)
    rate, plain = _rate(eta, reg), _scalar(reg)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n, state, met, steps_done = np.zeros_like(w0), 0, None, 0.0, 0
        total, touched = np.zeros_like(w0), np.zeros(d, bool)
        for b in batches:
            phase = b.column("phase").to_numpy()
            for p in (0, 1):
                part = b.filter(pa.array(phase == p))
                if not part.num_rows:
                    continue
                rows, y = feature_rows(part.column("features"), d), label_vector(part.column("label"))
                _, mult0 = loss.numpy(rows.margins(w0), y)
                steps = WalkRows(rows)
                if p == 0:
                    g += rows.gradient(mult0)
                    n += steps.n
                    touched[slice(None) if steps.dense else steps.idx] = True
                    continue
                state = state or LazyWeights(w0, g / n, eta, rate)
                met += walk(steps, y, mult0, range(steps.n), state, loss, total)
                steps_done += steps.n
        if n:
            at = np.flatnonzero(touched)
            yield sparse_slots(at, (total + steps_done * g / n)[:, at], d, shard_scalars(met, n, eta, plain), n)

    return kernel


def streamed_partials(ordered: DataFrame, kernel) -> DataFrame:
    """One kernel run a shard over its batches in order. Shards are streamed from sorted partitions,
    so that a shard is never held whole."""

    def slices(batches):
        for b in batches:
            shard = b.column("shard").to_numpy()
            cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shard)]):
                if hi > lo:
                    yield int(shard[lo]), b.slice(lo, hi - lo)

    def run(batches):
        for _, own in groupby(slices(batches), key=lambda piece: piece[0]):
            yield from kernel(b for _, b in own)

    return ordered.mapInArrow(run, SLOT_SCHEMA)
