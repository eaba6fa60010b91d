"""Variance-reduced trainers run as shard walks.

Both trainers need a sequential pass over rows, which only parallelises across shards. A
shard is a deterministic group of the sampled batch: ``pmod(xxhash64(key, row id), S)``
by default (the row id, a hash of the row's content, spreads a hot key over all shards), or
``pmod(key, S)``. ``S`` is a parameter, as the result depends on it. Shards of up to
``max_shard_bytes`` on average are walked in memory; beyond, Spark sorts their rows into the order of
the walk and they are streamed (:mod:`slopeline.operators.lazy_walks`), with the same result.
Sparse rows are walked as they are, with lazy steps.

``svrg`` (gradient aggregating)
    per shard: mean gradient ``mu`` at the current weights ``w`` over the shard; then
    ``n_s`` steps, each on a random row ``r`` (drawn with replacement from md5 of iteration,
    shard, step and seed, which any SQL engine can replay) or on the rows in key order: ``f = grad_r(w_loc) - grad_r(w) + mu``, sum ``f``,
    ``w_loc <- (1 - eta reg) w_loc - eta f``. The driver applies the plain/L2 step with
    ``Σ f / Σ n_s``.

``svrg_avg`` (weight averaging)
    ``mu`` is the mean gradient at ``w`` over a separate ``mean_fraction`` sample; each
    shard walks its rows once with the same corrected step from ``w``; the new weights are
    the mean of the shard weights.
"""

from __future__ import annotations

import hashlib
import math
import warnings
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeline.functions.losses import MarginLoss
from slopeline.functions.sampling import keyed_sample
from slopeline.operators import lazy_walks
from slopeline.operators.gradient import (DIRECT_MERGE_LIMIT, SLOT_SCHEMA, BatchSums, batch_sums, features_matrix,
                                          fetch_partials, is_sparse, label_vector, merge_slots, slot_batch)
from slopeline.operators.updates import penalised_step, penalty_value


def shards_fit(cfg, sharded: DataFrame, rows: int, d: int) -> bool:
    """Whether the shards of a batch are small enough, on average, to be walked in memory."""
    if is_sparse(sharded):
        entries = sharded.agg(F.sum(F.size("features.indices"))).first()[0] or 0
        return entries * 12 * cfg.fraction <= cfg.shards * cfg.max_shard_bytes
    return rows * cfg.fraction * d * 8 <= cfg.shards * cfg.max_shard_bytes


def shard_column(cfg, shards: int):
    if cfg.shard_by == "key_mod":
        return F.pmod(F.col("key"), F.lit(shards))
    return F.pmod(F.xxhash64(F.col("key"), F.col("_rid")), F.lit(shards))


def _ordered(table: pa.Table) -> pa.Table:
    keys = [("key", "ascending")] + ([("_rid", "ascending")] if "_rid" in table.column_names else [])
    return table.sort_by(keys)


def draw(i: int, shard: int, step: int, seed: int) -> float:
    """The uniform number of one step: 32 bits of md5 of ``iteration:shard:step:seed``."""
    return int(hashlib.md5(f"{i}:{shard}:{step}:{seed}".encode()).hexdigest()[:8], 16) / 4294967296.0


def _walk_order(n: int, order: str, seed: int, i: int, shard: int, with_replacement: bool) -> np.ndarray:
    if order == "key":
        return np.arange(n)
    u = np.array([draw(i, shard, k, seed) for k in range(n)])
    return np.floor(u * n).astype(np.int64) if with_replacement else np.argsort(u, kind="stable")


def svrg_kernel(w: np.ndarray, loss: MarginLoss, d: int, eta: float, shrink_reg: float, order: str,
                seed: int, i: int):
    """Shard kernel of the gradient-aggregating trainer; emits (Σ f, Σ loss) as slots."""
    k = loss.outputs
    w0 = np.asarray(w, dtype=np.float64).reshape(k, d)

    def kernel(table: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return pa.Table.from_batches([], schema=_SLOT_ARROW)
        shard = int(table.column("shard")[0].as_py())
        table = _ordered(table)
        x = features_matrix(table.column("features"), d)
        y = label_vector(table.column("label"))
        n = len(y)
        _, mult0 = loss.numpy(x @ w0.T, y)
        mu = mult0.T @ x / n
        walk = _walk_order(n, order, seed, i, shard, with_replacement=True)
        if k == 1:
            total, loss_sum = _svrg_walk_1(x, y, mult0[:, 0], mu[0], w0[0], walk, loss, eta, shrink_reg)
            return pa.Table.from_batches([slot_batch(np.concatenate([total, [loss_sum]]), n)])
        wl = w0.copy()
        total = np.zeros((k, d))
        loss_sum = 0.0
        for r in walk:
            xr = x[r]
            l_new, m_new = loss.numpy((wl @ xr)[None, :], y[r:r + 1])
            f = np.outer(m_new[0] - mult0[r], xr) + mu
            loss_sum += float(l_new[0])
            total += f
            wl = (1.0 - eta * shrink_reg) * wl - eta * f
        return pa.Table.from_batches([slot_batch(np.concatenate([total.ravel(), [loss_sum]]), n)])

    return kernel


def svrg_avg_kernel(w: np.ndarray, mu: np.ndarray, loss: MarginLoss, d: int, eta: float, shrink_reg: float,
                    order: str, seed: int, i: int):
    """Shard kernel of the weight-averaging trainer; emits (w_shard, Σ loss at w, 1)."""
    k = loss.outputs
    w0 = np.asarray(w, dtype=np.float64).reshape(k, d)
    mu = np.asarray(mu, dtype=np.float64).reshape(k, d)

    def kernel(table: pa.Table) -> pa.Table:
        if table.num_rows == 0:
            return pa.Table.from_batches([], schema=_SLOT_ARROW)
        shard = int(table.column("shard")[0].as_py())
        table = _ordered(table)
        x = features_matrix(table.column("features"), d)
        y = label_vector(table.column("label"))
        n = len(y)
        loss0, mult0 = loss.numpy(x @ w0.T, y)
        walk = _walk_order(n, order, seed, i, shard, with_replacement=False)
        if k == 1:
            wl = _svrg_avg_walk_1(x, y, mult0[:, 0], mu[0], w0[0], walk, loss, eta, shrink_reg)
            packed = np.concatenate([wl, [float(loss0.sum()), 1.0]])
            return pa.Table.from_batches([slot_batch(packed, n)])
        wl = w0.copy()
        for r in walk:
            xr = x[r]
            _, m_new = loss.numpy((wl @ xr)[None, :], y[r:r + 1])
            f = np.outer(m_new[0] - mult0[r], xr) + mu
            wl = (1.0 - eta * shrink_reg) * wl - eta * f
        packed = np.concatenate([wl.ravel(), [float(loss0.sum()), 1.0]])
        return pa.Table.from_batches([slot_batch(packed, n)])

    return kernel


def _svrg_walk_1(x, y, mult0, mu, w0, walk, loss, eta, shrink_reg):
    """Single-margin walk of the gradient-aggregating trainer, in place:
    ``f = (mult(w_loc) - mult(w)) x_r + mu``, ``S += f``, ``w_loc = shrink w_loc - eta f``."""
    shrink = 1.0 - eta * np.asarray(shrink_reg, dtype=np.float64).ravel() if np.ndim(shrink_reg) else 1.0 - eta * shrink_reg
    wl = w0.copy()
    acc = np.zeros_like(wl)
    tmp = np.empty_like(wl)
    eta_mu = eta * mu
    loss_sum = 0.0
    for r in walk:
        xr = x[r]
        l_new, m_new = loss.scalar(float(wl @ xr), float(y[r]))
        c = m_new - mult0[r]
        loss_sum += l_new
        np.multiply(xr, c, out=tmp)
        acc += tmp
        wl *= shrink
        tmp *= eta
        wl -= tmp
        wl -= eta_mu
    return acc + len(walk) * mu, loss_sum


def _svrg_avg_walk_1(x, y, mult0, mu, w0, walk, loss, eta, shrink_reg):
    """Single-margin walk of the weight-averaging trainer, in place."""
    shrink = 1.0 - eta * np.asarray(shrink_reg, dtype=np.float64).ravel() if np.ndim(shrink_reg) else 1.0 - eta * shrink_reg
    wl = w0.copy()
    tmp = np.empty_like(wl)
    eta_mu = eta * mu
    for r in walk:
        xr = x[r]
        _, m_new = loss.scalar(float(wl @ xr), float(y[r]))
        np.multiply(xr, eta * (m_new - mult0[r]), out=tmp)
        wl *= shrink
        wl -= tmp
        wl -= eta_mu
    return wl


_SLOT_ARROW = pa.schema([("slot", pa.int32()), ("value", pa.float64()), ("n", pa.int64())])


def sharded_table(table: DataFrame, cfg, shards: int) -> DataFrame:
    """The training table with its shard id, one partition a shard, once per fit.

    Every iteration's batch is a filter of this table, so grouping a batch by shard finds
    the rows already clustered and needs no shuffle; only the first iteration pays one."""
    return (table.withColumn("shard", shard_column(cfg, shards).cast("int"))
            .repartitionById(shards, "shard").persist(StorageLevel.MEMORY_AND_DISK))


def shard_partials(batch: DataFrame, kernel) -> DataFrame:
    cols = ["key", "label", "features", "shard"] + (["_rid"] if "_rid" in batch.columns else [])
    return batch.select(*cols).groupBy("shard").applyInArrow(kernel, SLOT_SCHEMA)


def reduce_partials(partials: DataFrame, length: int, expected: int) -> tuple[np.ndarray, int]:
    """Sum long-form partials into a vector of ``length`` slots plus the row total; the
    partials are summed by slot in a shuffle first when there are many of them."""
    if expected * length > DIRECT_MERGE_LIMIT:
        partials = merge_slots(partials)
        expected = 1
    t = fetch_partials(partials, expected * length)
    slot = t.column("slot").to_numpy()
    acc = np.bincount(slot, weights=t.column("value").to_numpy(), minlength=length)
    n = int(t.column("n").to_numpy()[slot == 0].sum())
    return acc[:length], n


def run(sharded: DataFrame, cfg, loss: MarginLoss, d: int, w: np.ndarray, result, rows: int) -> None:
    slots = loss.slots(d)
    reg = cfg.reg_weights(slots, loss.outputs)
    streamed = not shards_fit(cfg, sharded, rows, d)
    walk = _lazy_walk if streamed or is_sparse(sharded) else _dense_walk
    _walk_iterations(sharded, cfg, loss, d, w, result, cfg.shards, slots, reg, partial(walk, streamed=streamed))


def _dense_walk(batch, cfg, loss, d, w, mu, eta, reg, i, streamed: bool):
    """Sums over shards of ``f`` (``svrg``) or of the end weights, and the scalars LOSS, USED and ROWS."""
    slots, shrink = loss.slots(d), reg if not np.ndim(reg) else np.asarray(reg).reshape(loss.outputs, d)
    if mu is None:
        kernel = svrg_kernel(w, loss, d, eta, shrink, cfg.order, cfg.seed, i)
        acc, n = reduce_partials(shard_partials(batch, kernel), slots + 1, cfg.shards)
        return acc[:slots], float(acc[slots]), 0, n
    kernel = svrg_avg_kernel(w, mu, loss, d, eta, shrink, cfg.order, cfg.seed, i)
    acc, n = reduce_partials(shard_partials(batch, kernel), slots + 2, cfg.shards)
    return acc[:slots], float(acc[slots]), int(round(acc[slots + 1])), n


def _lazy_walk(batch, cfg, loss, d, w, mu, eta, reg, i, streamed: bool):
    """As :func:`_dense_walk`, by lazy steps over sparse or streamed rows."""
    slots, shrink = loss.slots(d), reg if not np.ndim(reg) else np.asarray(reg).reshape(loss.outputs, d)
    if streamed and mu is None:
        ordered = lazy_walks.twice_in_order(batch, cfg.shards, i, cfg.seed, cfg.order)
        partials = lazy_walks.streamed_partials(ordered, lazy_walks.streamed_svrg(w, loss, d, eta, shrink))
    elif streamed:
        ordered = lazy_walks.in_walk_order(batch, cfg.shards, i, cfg.seed, cfg.order)
        partials = lazy_walks.streamed_partials(ordered, lazy_walks.streamed_svrg_avg(w, mu, loss, d, eta, shrink))
    else:
        def order_of(n, shard):
            return _walk_order(n, cfg.order, cfg.seed, i, shard, with_replacement=mu is None)

        if mu is None:
            kernel = lazy_walks.sparse_svrg_kernel(w, loss, d, eta, shrink, order_of)
        else:
            kernel = lazy_walks.sparse_svrg_avg_kernel(w, mu, loss, d, eta, shrink, order_of)
        partials = shard_partials(batch, kernel)
    acc, scalars = lazy_walks.reduce_slots(partials, slots, cfg.shards * slots)
    used, n = int(scalars[lazy_walks.USED]), int(scalars[lazy_walks.ROWS])
    if mu is not None and used:
        acc = lazy_walks.averaged(w, np.ravel(mu), acc, scalars, eta, reg, 1.0)
    return acc, float(scalars[lazy_walks.LOSS]), used, n


def _walk_iterations(table, cfg, loss, d, w, result, shards, slots, reg, walk) -> None:
    from slopeline.operators.trainers import HistoryEntry, converged

    partitions = shards
    reg_val = penalty_value(w, reg, cfg.penalty)
    updates = 0
    for i in range(1, cfg.iters + 1):
        result.iterations = i
        seed = cfg.seed + i
        eta = cfg.step / math.sqrt(i)
        batch = keyed_sample(table, "key", cfg.fraction, seed, cfg.sampler, cfg.salt())
        if cfg.method == "svrg":
            acc, loss_sum, _, n = walk(batch, cfg, loss, d, w, None, eta, reg, i)
            if n == 0:
                warnings.warn(f"iteration {i}/{cfg.iters}: the sampled batch is empty", stacklevel=3)
                continue
            result.history.append(HistoryEntry(i, loss_sum / n, reg_val, n))
            new_w = penalised_step(w, acc / n, eta, reg, cfg.penalty)
        else:
            mean_batch = keyed_sample(table, "key", cfg.mean_fraction, seed, cfg.sampler, cfg.salt())
            mean_sums: BatchSums = batch_sums(mean_batch, w, loss, d, kernel=cfg.kernel, partitions=partitions)
            if not mean_sums.count:
                warnings.warn(f"iteration {i}/{cfg.iters}: the sample for the mean gradient is empty", stacklevel=3)
                continue
            mu = mean_sums.mean_grad
            acc, loss_sum, used, n = walk(batch, cfg, loss, d, w, mu, eta, reg, i)
            if n == 0 or used == 0:
                warnings.warn(f"iteration {i}/{cfg.iters}: the sampled batch is empty", stacklevel=3)
                continue
            if cfg.variant == "observed":
                # empty shards count with the starting weights; loss over the mean sample size
                new_w = (acc + (shards - used) * w) / shards
                denom = mean_sums.count
            else:
                new_w = acc / used
                denom = n
            result.history.append(HistoryEntry(i, loss_sum / denom, reg_val, n))
        reg_val = penalty_value(new_w, reg, cfg.penalty)
        updates += 1
        stop = updates >= 2 and converged(w, new_w, cfg.tol)
        w = new_w
        if stop:
            result.converged = True
            break
    result.weights = w
    result.updates = updates
