"""Vector maths as Spark column expressions.

Feature vectors live in an ``ARRAY<DOUBLE>`` (or ``ARRAY<FLOAT>``) column. Weights live
on the driver as a NumPy vector. A dot product against fixed weights is written as an
unrolled sum of ``features[j] * w_j`` so it stays inside whole-stage codegen (higher-order
functions such as ``aggregate(zip_with(...))`` fall back to interpreted evaluation). Past
``UNROLL_LIMIT`` entries the generated method would grow too large, and callers switch to
the Arrow kernels in :mod:`slopeline.operators.gradient`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

UNROLL_LIMIT = 256


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tree_sum(terms: Sequence[Column]) -> Column:
    """Sum of columns as a balanced tree, so expression depth grows with log(len)."""
    terms = list(terms)
    if not terms:
        return F.lit(0.0)
    while len(terms) > 1:
        nxt = [terms[k] + terms[k + 1] for k in range(0, len(terms) - 1, 2)]
        if len(terms) % 2:
            nxt.append(terms[-1])
        terms = nxt
    return terms[0]


def element(features: str | Column, j: int) -> Column:
    """``features[j]`` as DOUBLE (FLOAT embeddings are widened before any arithmetic)."""
    return as_column(features).getItem(j).cast("double")


def dot_slice(features: str | Column, weights: np.ndarray, start: int, length: int,
              bias_index: int | None = None) -> Column:
    """Dot product of ``features`` with ``weights[start:start+length]`` (one class block),
    adding ``weights[bias_index]`` when the block carries a bias slot."""
    block = np.asarray(weights[start:start + length], dtype=np.float64)
    terms = [element(features, j) * F.lit(float(block[j])) for j in range(length) if block[j] != 0.0]
    out = tree_sum(terms)
    if bias_index is not None:
        out = out + F.lit(float(weights[bias_index]))
    return out


def log1pexp(x: Column) -> Column:
    """Numerically stable ``log(1 + e^x)``."""
    return F.when(x > 0, x + F.log1p(F.exp(-x))).otherwise(F.log1p(F.exp(x)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def np_log1pexp(x: np.ndarray) -> np.ndarray:
    """NumPy twin of :func:`log1pexp`."""
    return np.logaddexp(0.0, x)


def dot_array(features: str | Column, weights: Sequence[float]) -> Column:
    """``x . w`` with the weights passed as one array literal.

    Array literals are held by reference in generated code, so a plan that only changes
    the weight values between iterations reuses the compiled code (the unrolled form
    inlines every weight and recompiles each time). Used by iterative column kernels.
    """
    w = F.array(*[F.lit(float(v)) for v in np.asarray(weights, dtype=np.float64)])
    prods = F.zip_with(as_column(features), w, lambda a, b: a.cast("double") * b)
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)
