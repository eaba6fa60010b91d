"""Loss operators (binary logistic, multinomial logistic, least squares, hinge).

Every loss of a linear model has a gradient of the form ``multiplier * x``, so a loss is
described by what it does to one row's margin(s): the row loss and the multiplier(s).
Each loss has two faces that compute the same numbers:

* ``columns(margins, y)`` -- Spark column expressions, used for per-row loss tables and
  for the JVM-side gradient kernel;
* ``numpy(margins, y)`` -- array code over an Arrow batch, used inside ``mapInArrow`` /
  ``applyInArrow`` kernels.

A loss with ``outputs > 1`` (multinomial) works on ``outputs`` margins per row and owns
``outputs * d`` weight slots laid out class-major (class 1 first; class 0 is the pivot).
User losses (the extension point) subclass :class:`MarginLoss`.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from slopeline.functions.linalg import log1pexp, np_log1pexp, tree_sum


class MarginLoss:
    """A loss of the form ``loss(x.w, y)`` with gradient ``mult(x.w, y) * x``.

    Subclasses implement :meth:`columns` and, for the fast Arrow kernel, :meth:`numpy`.
    ``margins`` is a list with one entry per output (one for binary/regression losses).
    """

    name = "custom"
    outputs = 1
    binary_labels = False

    def columns(self, margins: list[Column], y: Column) -> tuple[Column, list[Column]]:
        raise NotImplementedError

    def numpy(self, margins: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``margins`` has shape (n, outputs); returns (loss (n,), mult (n, outputs))."""
        raise NotImplementedError

    def scalar(self, z: float, y: float) -> tuple[float, float]:
        """(loss, mult) of one row with margin ``z``; used by sequential walks (SVRG),
        where per-row array calls would dominate. Defaults to the NumPy form."""
        loss, mult = self.numpy(np.array([[z]]), np.array([y]))
        return float(loss[0]), float(mult[0, 0])

    @property
    def has_numpy(self) -> bool:
        return type(self).numpy is not MarginLoss.numpy

    def slots(self, d: int) -> int:
        return self.outputs * d


class LogisticLoss(MarginLoss):
    """Binary logistic loss (G1): with ``m = -x.w``, ``mult = 1/(1+e^m) - y`` and
    ``loss = log1pexp(m)`` for a positive label, ``log1pexp(m) - m`` otherwise."""

    name = "logistic"
    binary_labels = True

    def columns(self, margins, y):
        m = -margins[0]
        mult = F.lit(1.0) / (F.lit(1.0) + F.exp(m)) - y
        lpe = log1pexp(m)
        loss = F.when(y > 0, lpe).otherwise(lpe - m)
        return loss, [mult]

    def numpy(self, margins, y):
        m = -margins[:, 0]
        with np.errstate(over="ignore"):
            mult = 1.0 / (1.0 + np.exp(m)) - y
        lpe = np_log1pexp(m)
        loss = np.where(y > 0, lpe, lpe - m)
        return loss, mult[:, None]

    def scalar(self, z, y):
        m = -z
        mult = (1.0 / (1.0 + math.exp(m)) if m < 709.0 else 0.0) - y
        lpe = m + math.log1p(math.exp(-m)) if m > 0 else math.log1p(math.exp(m))
        return (lpe if y > 0 else lpe - m), mult


class LeastSquaresLoss(MarginLoss):
    """Least squares (G3): ``diff = x.w - y``, ``loss = diff^2 / 2``, ``mult = diff``."""

    name = "least_squares"

    def columns(self, margins, y):
        diff = margins[0] - y
        return diff * diff / F.lit(2.0), [diff]

    def numpy(self, margins, y):
        diff = margins[:, 0] - y
        return diff * diff / 2.0, diff[:, None]

    def scalar(self, z, y):
        diff = z - y
        return diff * diff / 2.0, diff


class HingeLoss(MarginLoss):
    """Hinge (G4) with labels {0,1} read as -1/+1: ``z = 2y - 1``; when ``1 > z * x.w``
    the loss is ``1 - z * x.w`` and the multiplier ``-z``, else both are 0."""

    name = "hinge"
    binary_labels = True

    def columns(self, margins, y):
        z = F.lit(2.0) * y - F.lit(1.0)
        zm = z * margins[0]
        active = F.lit(1.0) > zm
        loss = F.when(active, F.lit(1.0) - zm).otherwise(F.lit(0.0))
        mult = F.when(active, -z).otherwise(F.lit(0.0))
        return loss, [mult]

    def numpy(self, margins, y):
        z = 2.0 * y - 1.0
        zm = z * margins[:, 0]
        active = 1.0 > zm
        loss = np.where(active, 1.0 - zm, 0.0)
        mult = np.where(active, -z, 0.0)
        return loss, mult[:, None]

    def scalar(self, m, y):
        z = 2.0 * y - 1.0
        zm = z * m
        return (1.0 - zm, -z) if 1.0 > zm else (0.0, 0.0)


class MultinomialLoss(MarginLoss):
    """Multinomial logistic loss (G2), pivot class 0, ``K - 1`` margins per row.

    ``loss = log(1 + sum_c e^{m_c}) - [y > 0] m_y`` and ``mult_c = e^{m_c} / (1 + sum) - [y = c]``,
    evaluated after shifting by ``max(0, max_c m_c)`` so no exponent overflows.
    """

    name = "multinomial"
    binary_labels = False

    def __init__(self, num_classes: int):
        if num_classes < 2:
            raise ValueError("num_classes must be at least 2")
        self.num_classes = num_classes
        self.outputs = num_classes - 1

    def columns(self, margins, y):
        shift = F.greatest(F.lit(0.0), *margins) if len(margins) > 1 else F.greatest(F.lit(0.0), margins[0])
        exps = [F.exp(m - shift) for m in margins]
        denom = F.exp(-shift) + tree_sum(exps)
        # the margin of the true class (0 for the pivot class)
        margin_y = F.lit(0.0)
        for c in range(len(margins) - 1, -1, -1):
            margin_y = F.when(y == F.lit(float(c + 1)), margins[c]).otherwise(margin_y)
        loss = shift + F.log(denom) - margin_y
        mults = [e / denom - F.when(y == F.lit(float(c + 1)), 1.0).otherwise(0.0) for c, e in enumerate(exps)]
        return loss, mults

    def array_columns(self, z: Column, y: Column) -> tuple[Column, Column]:
        """Loss and multipliers from one array column of margins: the same formula for any
        number of classes, without a column expression for each."""
        shift = F.greatest(F.lit(0.0), F.array_max(z))
        exps = F.transform(z, lambda m: F.exp(m - shift))
        denom = F.exp(-shift) + F.aggregate(exps, F.lit(0.0), lambda a, e: a + e)
        margin_y = F.when(y > 0, F.get(z, y.cast("int") - 1)).otherwise(F.lit(0.0))
        loss = shift + F.log(denom) - margin_y
        return loss, F.transform(exps, lambda e, c: e / denom - F.when(y == (c + 1).cast("double"), 1.0).otherwise(0.0))

    def numpy(self, margins, y):
        shift = np.maximum(0.0, margins.max(axis=1))
        exps = np.exp(margins - shift[:, None])
        denom = np.exp(-shift) + exps.sum(axis=1)
        cls = y.astype(np.int64)
        onehot = (cls[:, None] == np.arange(1, self.outputs + 1)[None, :]).astype(np.float64)
        margin_y = (margins * onehot).sum(axis=1)
        loss = shift + np.log(denom) - margin_y
        mult = exps / denom[:, None] - onehot
        return loss, mult


_BUILTIN = {"logistic": LogisticLoss, "least_squares": LeastSquaresLoss, "hinge": HingeLoss}


def resolve_loss(loss: str | MarginLoss, num_classes: int = 2) -> MarginLoss:
    """Loss object from a name (``logistic``, ``least_squares``, ``hinge``, ``multinomial``)."""
    if isinstance(loss, MarginLoss):
        return loss
    if loss == "multinomial" or (loss == "logistic" and num_classes > 2):
        return MultinomialLoss(num_classes)
    try:
        return _BUILTIN[loss]()
    except KeyError:
        raise ValueError(f"unknown loss {loss!r}; expected one of {sorted(_BUILTIN) + ['multinomial']}") from None
