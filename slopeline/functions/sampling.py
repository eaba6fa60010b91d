"""Row selection by key: mini-batches, mean-gradient samples and train/test splits.

``DataFrame.sample`` draws a Bernoulli sample per partition, so the rows it picks change
with the partition layout. A *keyed* draw instead hashes ``(key, seed)`` to a uniform
number in [0, 1) and keeps the row when that number is below the fraction: the same rows
come out under any layout, on any cluster size, and after an executor is lost and its
partitions are recomputed.

Two hashes are offered:

* ``xxhash64`` -- Spark's built-in 64-bit hash; cheapest, the default for large runs;
* ``md5`` -- first 32 bits of ``md5(key || ':' || seed)``; slower, but any SQL engine can
  compute the same value, which is what the DuckDB checks use.

``bernoulli`` keeps the layout-dependent ``DataFrame.sample`` for parity with the
original trainers.

Hashing the key alone keeps every row of a key together: right when the key names a row,
but a key (or a block of copied rows) holding a large share of the table would then enter
or leave a batch whole. Passing ``salt`` (a stable row id) hashes ``(key, salt)`` so such
groups are spread like any other rows; the draw is then fixed for a given input (and after
executor loss) rather than for any layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLERS = ("xxhash64", "md5", "bernoulli")

# The per-iteration seed of iteration i is BASE_SEED + i, and the
# train/test split of the experiment uses SPLIT_SEED with a 0.7 / 0.3 split.
BASE_SEED = 42
SPLIT_SEED = 11
SPLIT_WEIGHTS = (0.7, 0.3)

_TWO_32 = 4294967296.0
_TWO_53 = 9007199254740992


def uniform(key: str | Column, seed: int, sampler: str = "xxhash64", salt: str | Column | None = None) -> Column:
    """A number in [0, 1) that depends only on ``(key, seed)`` (and ``salt`` if given)."""
    k = F.col(key) if isinstance(key, str) else key
    extra = [] if salt is None else [F.col(salt) if isinstance(salt, str) else salt]
    if sampler == "md5":
        # a null key or salt counts as an empty string: every row has a draw
        parts = [p for e in (k, *extra) for p in (F.coalesce(e.cast("string"), F.lit("")), F.lit(":"))]
        digest = F.md5(F.concat(*parts, F.lit(str(int(seed)))))
        head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
        return head.cast("double") / F.lit(_TWO_32)
    if sampler == "xxhash64":
        h = F.pmod(F.xxhash64(k, *extra, F.lit(int(seed))), F.lit(_TWO_53))
        return h.cast("double") / F.lit(float(_TWO_53))
    raise ValueError(f"sampler {sampler!r} has no keyed form; use one of 'xxhash64', 'md5'")


def keyed_sample(df: DataFrame, key: str, fraction: float, seed: int, sampler: str = "xxhash64",
                 salt: str | None = None) -> DataFrame:
    """Rows whose keyed uniform draw is below ``fraction`` (all rows when fraction >= 1)."""
    if fraction >= 1.0:
        return df
    if sampler == "bernoulli":
        return df.sample(withReplacement=False, fraction=float(fraction), seed=int(seed))
    return df.where(uniform(key, seed, sampler, salt) < F.lit(float(fraction)))


def batch_seed(iteration: int, base: int = BASE_SEED) -> int:
    """Seed of the mini-batch of 1-based ``iteration``."""
    return base + iteration


def keyed_split(df: DataFrame, key: str, weights=SPLIT_WEIGHTS, seed: int = SPLIT_SEED,
                sampler: str = "md5", salt: str | Column | None = None) -> list[DataFrame]:
    """Split by key into parts with the given relative weights; the parts are disjoint
    and together hold every row (rows with a null key too), whatever the layout. With
    ``salt``, a column that tells the rows of a key apart, the split is by row: a key that
    many rows share is spread over the parts."""
    total = float(sum(weights))
    u = uniform(key, seed, sampler, salt)
    bounds, acc = [], 0.0
    for w in weights:
        lo = acc
        acc += w / total
        bounds.append((lo, acc))
    parts = []
    for idx, (lo, hi) in enumerate(bounds):
        cond = u >= F.lit(lo) if idx else F.lit(True)
        if idx < len(bounds) - 1:
            cond = cond & (u < F.lit(hi))
        parts.append(df.where(cond))
    return parts


def split_label(df: DataFrame, key: str, train_fraction: float = SPLIT_WEIGHTS[0], seed: int = SPLIT_SEED,
                sampler: str = "md5", name: str = "split", salt: str | Column | None = None) -> DataFrame:
    """Tag each row 'train' or 'test' (the two-way form of :func:`keyed_split`)."""
    return df.withColumn(name, F.when(uniform(key, seed, sampler, salt) < F.lit(float(train_fraction)), "train")
                         .otherwise("test"))
