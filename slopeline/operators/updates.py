"""Update rules: plain, L1-proximal and squared-L2 steps, and the state rules of the
Momentum, AdaGrad, AdaDelta and Adam trainers.

Each rule is element-wise, so it is written once against a small ``ops`` namespace and runs
on NumPy vectors (dense mode, O(d) on the driver) or on Spark columns of a weight table
(wide mode, one projection over ``(idx, weight, grad, state...)``).

Step size of iteration ``i`` is ``eta_i = step / sqrt(i)`` for the plain, L1, L2 and
momentum rules; AdaGrad, AdaDelta and Adam use ``step`` without decay.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F

# Fixed values of the adaptive rules (decay rates and their complements are written
# out, so the arithmetic matches the original constants exactly).
MOMENTUM = 0.9
ADAGRAD_EPS = 1e-6
ADADELTA_RHO, ADADELTA_KEEP_NEW = 0.95, 0.05
ADADELTA_EPS = 1e-6
ADAM_BETA1, ADAM_KEEP_M = 0.9, 0.1
ADAM_BETA2, ADAM_KEEP_V = 0.99, 0.01
ADAM_EPS = 1e-8

PENALTIES = ("none", "l1", "l2")
STATE = {
    "sgd": (),
    "momentum": ("prev",),
    "adagrad": ("gsq",),
    "adadelta": ("esq", "dsq"),
    "adam": ("m", "v"),
}


class ArrayOps:
    sqrt = staticmethod(np.sqrt)
    abs = staticmethod(np.abs)
    sign = staticmethod(np.sign)

    @staticmethod
    def pos(x):
        return np.maximum(0.0, x)


class ColumnOps:
    sqrt = staticmethod(F.sqrt)
    abs = staticmethod(F.abs)
    sign = staticmethod(F.signum)

    @staticmethod
    def pos(x):
        return F.greatest(F.lit(0.0), x)


@dataclass(frozen=True)
class StepContext:
    """Scalars of one update: 1-based iteration ``i``, number of updates already applied
    ``t`` (empty batches advance ``i`` but not ``t``), base step, regularisation weight
    (a scalar, or a per-slot vector in dense mode)."""

    i: int
    t: int
    step: float
    reg: object
    penalty: str = "l2"
    variant: str = "published"

    @property
    def eta(self) -> float:
        return self.step / math.sqrt(self.i)


@dataclass(frozen=True)
class UpdateRule:
    """A user rule for both modes: ``step(w, g, state, ctx, ops) -> (w, state)`` written element by
    element against ``ops`` (``sqrt``, ``abs``, ``sign``, ``pos`` and plain arithmetic), so that it runs on NumPy
    vectors and on the columns of a weight table alike. ``state`` names vectors that start at
    zero and are handed back to the next step."""

    step: Callable
    state: tuple = ()

    def __call__(self, w, g, state, ctx, ops=ArrayOps):
        state = state or {name: w * 0.0 for name in self.state}
        new_w, new_state = self.step(w, g, state, ctx, ops)
        if set(new_state) != set(self.state):
            raise ValueError(f"the rule returns state {sorted(new_state)}, not {sorted(self.state)}")
        return new_w, new_state


def penalised_step(w, g, eta: float, reg: float, penalty: str, ops=ArrayOps):
    """U1-U3: ``w - eta g`` (none), soft threshold after the step (l1), or
    ``(1 - eta reg) w - eta g`` (l2)."""
    if penalty == "none":
        return w - eta * g
    if penalty == "l1":
        u = w - eta * g
        return ops.sign(u) * ops.pos(ops.abs(u) - reg * eta)
    if penalty == "l2":
        return (1.0 - eta * reg) * w - eta * g
    raise ValueError(f"unknown penalty {penalty!r}")


def penalty_value(w: np.ndarray, reg, penalty: str) -> float:
    """Regularisation value of a weight vector: 0, ``reg |w|_1`` or ``reg/2 |w|_2^2``
    (``reg`` may be a per-slot vector)."""
    if penalty == "none" or np.all(np.asarray(reg) == 0.0):
        return 0.0
    if np.ndim(reg):
        return float(np.sum(reg * np.abs(w))) if penalty == "l1" else 0.5 * float(np.sum(reg * w * w))
    if penalty == "l1":
        return reg * float(np.abs(w).sum())
    return 0.5 * reg * float(np.dot(w, w))


def init_state(method: str, w):
    return {name: w * 0.0 for name in STATE[method]}


def apply_rule(method: str, w, g, state: dict, ctx: StepContext, ops=ArrayOps):
    """One update of ``method``; returns ``(new_weights, new_state)``.

    ``state`` holds the method's vectors (see :data:`STATE`); for momentum ``prev`` is the
    weight vector before the previous update and is only meaningful once ``ctx.t >= 1``.
    """
    s, reg = ctx.step, ctx.reg
    if method == "sgd":
        return penalised_step(w, g, ctx.eta, reg, ctx.penalty, ops), state

    if method == "momentum":
        if ctx.t == 0:
            new = penalised_step(w, g, ctx.eta, reg, ctx.penalty, ops)
        elif ctx.variant == "observed":
            # second update subtracts the whole weight vector; later ones a doubly
            # step-scaled difference, as the original trainer did
            if ctx.t == 1:
                new = penalised_step(w, g - w, ctx.eta, reg, ctx.penalty, ops)
            else:
                new = penalised_step(w, g - MOMENTUM * ctx.eta * (w - state["prev"]), ctx.eta, reg, ctx.penalty, ops)
        else:
            # heavy ball: gradient step plus a fraction of the last move
            new = penalised_step(w, g, ctx.eta, reg, ctx.penalty, ops) + MOMENTUM * (w - state["prev"])
        return new, {"prev": w}

    if method == "adagrad":
        gsq = state["gsq"] + g * g
        rate = 1.0 / ops.sqrt(gsq + ADAGRAD_EPS)
        new = (1.0 - s * reg * rate) * w - s * rate * g
        return new, {"gsq": gsq}

    if method == "adadelta":
        t = g + reg * w
        esq = ADADELTA_RHO * state["esq"] + ADADELTA_KEEP_NEW * t * t
        move = ops.sqrt(state["dsq"] + ADADELTA_EPS) / ops.sqrt(esq + ADADELTA_EPS) * t
        dsq = ADADELTA_RHO * state["dsq"] + ADADELTA_KEEP_NEW * move * move
        # observed rule adds the running mean of squared moves; published subtracts the move
        new = w + dsq if ctx.variant == "observed" else w - move
        return new, {"esq": esq, "dsq": dsq}

    if method == "adam":
        t = g + reg * w
        v = ADAM_BETA2 * state["v"] + ADAM_KEEP_V * t * t
        m = ADAM_BETA1 * state["m"] + ADAM_KEEP_M * t
        if ctx.variant == "observed":
            # constant "bias corrections" 0.1 and 0.01, as the original trainer did
            m_hat, v_hat = m / ADAM_KEEP_M, v / ADAM_KEEP_V
        else:
            k = ctx.t + 1
            m_hat, v_hat = m / (1.0 - ADAM_BETA1 ** k), v / (1.0 - ADAM_BETA2 ** k)
        new = w - s * m_hat / (ops.sqrt(v_hat) + ADAM_EPS)
        return new, {"m": m, "v": v}

    raise ValueError(f"unknown update method {method!r}")


def records_history(method: str, variant: str) -> bool:
    """The observed AdaDelta and Adam trainers kept no loss history."""
    return not (method in ("adadelta", "adam") and variant == "observed")


def reg_penalty(method: str, penalty: str) -> str:
    """Penalty whose value is reported: AdaGrad, AdaDelta and Adam always use squared L2."""
    return "l2" if method in ("adagrad", "adadelta", "adam") else penalty
