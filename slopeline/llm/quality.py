"""Quality rules: robust multivariate outliers among documents.

Each document gets five text statistics, transformed to a vector. Per language and source the
location and scatter of the vectors are estimated by the minimum covariance determinant: of all
subsets of three quarters of the rows, the one whose covariance has the least determinant, found
by concentration steps from two fixed starts. Documents far from the centre by Mahalanobis
distance are rejected.

A concentration step is one aggregation. Rows are joined with the estimate of their cell,
distances are cut into narrow bins (1/16 of a factor of two), and counts and moments are summed
per cell and bin; the nearest bins that hold three quarters of a cell give the next estimate.
Sums combine on the map side, so a cell with a third of all rows is no hot group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_batches, written
from .text import LEAD, covered, line_spans, per_text, repeated, salted, span_hashes, text_pieces, whole_windows, window_hashes, word_spans

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: Least standard deviation of each transformed statistic (log words, log word length, log of one
#: plus ten times symbols a word, log of one plus repeated lines, root of the repeated share):
#: a statistic that is constant in a cell must not turn one symbol into an outlier, and sound documents
#: are of very different lengths.
FLOOR = (1.25, 0.11, 0.25, 0.35, 0.2)
COVERAGE = 0.75
#: A clean Gaussian document is rejected with this probability.
TAIL = 1e-4
#: Cells with fewer rows are pooled with the other small sources of their language, then over all.
LEAST_ROWS = 50
BROADCAST_CELLS = 20_000
SALTS = 64


def chi2_cdf(x: float, k: int) -> float:
    """Chi-squared distribution function, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, half = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= half / (a + n)
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def chi2_quantile(q: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < q else (lo, mid)
    return hi


def statistics(column: pa.Array) -> np.ndarray:
    """The five counts (columns of STATS) of each text; null and empty texts have zeros."""
    out = [np.zeros((0, P), np.int64)]
    for lo, hi, data, offsets in text_pieces(column):
        n = hi - lo
        starts, ends = word_spans(data, offsets)
        counts = per_text(starts, offsets)
        text = np.repeat(np.arange(n), counts)
        lengths = np.bincount(text, weights=(ends - starts), minlength=n).astype(np.int64)
        inner = per_text(np.flatnonzero(~LEAD[data]), offsets)  # never white space, so within words
        at = whole_windows(counts, 3)
        keys = window_hashes(span_hashes(data, starts, ends), 3)[at] if len(at) else np.zeros(0, np.uint64)
        twice = at[repeated(salted(keys, text[at]))]
        n_repeat = np.bincount(text[covered(twice, 3, len(starts))], minlength=n)
        begin, end = line_spans(data, offsets)
        words = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
        begin, end = begin[words], end[words]
        owner = np.repeat(np.arange(n), per_text(begin, offsets))
        _, first = np.unique(salted(span_hashes(data, begin, end), owner), return_index=True)
        n_dup = per_text(begin, offsets) - np.bincount(owner[first], minlength=n)
        symbols = per_text(np.flatnonzero(SYMBOL[data]), offsets)
        out.append(np.stack([counts, lengths - inner, symbols, n_dup, n_repeat], axis=1))
    return np.concatenate(out)


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts of every document's whole text."""
    text_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = statistics(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(x[:, i], pa.int64()) for i in range(P))],
                names=["doc_id", "lang", "source", *STATS])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"))
    return rows.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{s} long" for s in STATS))


def vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log((F.col("word_chars") + 1) / n),
        F.log1p(10 * F.col("n_symbols") / n),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance of z0..z4 under the joined columns mean and inv."""
    d = [F.col(f"z{i}") - F.col("mean")[i] for i in range(P)]
    return sum(((1 if i == j else 2) * F.col("inv")[i * P + j] * d[i] * d[j] for i, j in PAIRS), F.lit(0.0))


def _moments() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *(F.sum(f"z{i}").alias(f"s{i}") for i in range(P)),
            *(F.sum(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"s{i}{j}") for i, j in PAIRS)]


ESTIMATE = "cell string, start int, mean array<double>, inv array<double>, logdet double"
SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"s{i}{j}" for i, j in PAIRS)]


def _fits(sums: DataFrame, factor: float) -> DataFrame:
    """Mean, inverse scatter and log determinant from one row of summed moments per cell and
    start. No direction of the scatter, measured in floors, varies by less than one, so it is never
    singular; a direction that varies more keeps its estimate."""

    def run(batches):
        for b in batches:
            x = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in SUMS], axis=1)
            mean = x[:, 1 : 1 + P] / x[:, :1]
            cov = np.zeros((len(x), P, P))
            for k, (i, j) in enumerate(PAIRS):
                cov[:, i, j] = cov[:, j, i] = x[:, 1 + P + k] / x[:, 0] - mean[:, i] * mean[:, j]
            width, turned = np.linalg.eigh(factor * cov / np.outer(FLOOR, FLOOR))
            cov = (turned * np.maximum(width, 1.0)[:, None, :]) @ turned.transpose(0, 2, 1) * np.outer(FLOOR, FLOOR)
            yield pa.RecordBatch.from_arrays(
                [b.column("cell"), b.column("start"), pa.array(list(mean), pa.list_(pa.float64())),
                 pa.array(list(np.linalg.inv(cov).reshape(len(x), P * P)), pa.list_(pa.float64())), pa.array(np.linalg.slogdet(cov)[1])],
                names=["cell", "start", "mean", "inv", "logdet"])

    return sums.select("cell", "start", *SUMS).mapInArrow(run, ESTIMATE)


def _estimates(binned: DataFrame, share: float, factor: float) -> DataFrame:
    """The next estimate of each cell and start from its nearest bins that hold ``share`` of it."""
    each = Window.partitionBy("cell", "start")
    upto = each.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    near = (binned.withColumn("_before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("_all", F.sum("n").over(each))
            .filter(F.col("_before") < share * F.col("_all") - 1e-9))
    return _fits(near.groupBy("cell", "start").agg(*(F.sum(c).alias(c) for c in SUMS)), factor)


def _with_estimates(rows: DataFrame, est: DataFrame, n_cells: int, how: str = "inner") -> DataFrame:
    """``rows`` with their cell's estimates. Up to ``BROADCAST_CELLS`` cells (some 300 bytes each) the
    estimates are broadcast; beyond, the join is salted, so that a cell with a third of all
    rows is split over ``SALTS`` tasks."""
    if n_cells <= BROADCAST_CELLS:
        return rows.join(F.broadcast(est), "cell", how)
    salt = F.pmod(F.xxhash64(*(f"z{i}" for i in range(P))), F.lit(SALTS)).cast("int")
    copies = est.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, ["cell", "_salt"], how).drop("_salt")


def _binned(rows: DataFrame, est: DataFrame, n_cells: int) -> DataFrame:
    near = _with_estimates(rows, est.select("cell", "start", "mean", "inv"), n_cells).withColumn("d2", _distance())
    bins = F.floor(16 * F.log2(F.greatest(F.col("d2"), F.lit(1e-6)))).cast("int")
    return near.groupBy("cell", "start", bins.alias("bin")).agg(*_moments())


def _cells(rows: DataFrame) -> DataFrame:
    """Each row's estimation cell: language and source, or the pool of small ones."""
    whole = F.to_json(F.struct("lang", "source"))
    pool = F.concat(F.lit("small "), F.to_json(F.struct("lang")))
    sizes = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    small = sizes.filter(F.col("n") < LEAST_ROWS).groupBy("lang").agg(F.sum("n").alias("pooled"))
    cells = (sizes.join(small.withColumnRenamed("lang", "l"), F.col("lang").eqNullSafe(F.col("l")), "left")
             .select(F.col("lang").alias("l"), F.col("source").alias("s"),
                     F.when(F.col("n") >= LEAST_ROWS, whole).when(F.col("pooled") >= LEAST_ROWS, pool).otherwise(F.lit("small")).alias("cell")))
    return rows.join(cells, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))).drop("l", "s")


def estimate(rows: DataFrame, n_cells: int) -> DataFrame:
    """Minimum-covariance-determinant estimates of each cell of ``rows`` (cell, z0..z4): concentration
    steps until the determinants no longer fall."""
    factor = COVERAGE / chi2_cdf(chi2_quantile(COVERAGE, P), P + 2)
    rough = [F.percentile(F.round(f"z{i}", 2), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(P)]
    # One start from medians and quartiles (rounded values, so the counts stay small), one from
    # the plain mean and covariance.
    widths = [F.greatest(F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2), F.lit(FLOOR[i] ** 2)) for i in range(P)]
    medians = rows.groupBy("cell").agg(*rough).select(
        "cell", F.lit(0).alias("start"), F.array(*(F.col(f"q{i}")[1] for i in range(P))).alias("mean"),
        F.array(*((1 / widths[i] if i == j else F.lit(0.0)) for i in range(P) for j in range(P))).alias("inv"), F.lit(None).cast("double").alias("logdet"))
    plain = _fits(rows.groupBy("cell").agg(*_moments()).withColumn("start", F.lit(1)), 1.0)
    est = written(medians.unionByName(plain), "mcd")
    before = None
    while True:
        est = written(_estimates(_binned(rows, est, n_cells), COVERAGE, factor), "mcd")
        now = est.agg(F.sum("logdet")).first()[0]
        # Each step lowers every determinant or ends it (up to the width of the bins).
        if now is None or before is not None and now > before - 1e-6 * max(1.0, abs(now)):
            break
        before = now
    best = est.groupBy("cell").agg(F.min_by(F.struct("mean", "inv"), F.struct("logdet", "start")).alias("e")).select("cell", F.lit(0).alias("start"), "e.mean", "e.inv")
    # Reweighting: mean and covariance of the rows that the raw estimate does not call outliers.
    edge = chi2_quantile(0.975, P)
    inliers = _with_estimates(rows, best.drop("start"), n_cells).filter(_distance() <= edge).groupBy("cell").agg(*_moments()).withColumn("start", F.lit(0))
    return written(_fits(inliers, 0.975 / chi2_cdf(edge, P + 2)), "mcd").select("cell", "mean", "inv")


def quality_verdicts(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """One row per document row: the counts, ``base_failed``, ``distance`` and ``kept``.

    Null and empty texts have no words and fail the base rules. Null languages or sources form
    cells of their own. Base failures take no part in the estimates and have no distance. Cells
    are pooled as ``LEAST_ROWS`` says. Equal rows get equal verdicts; extra columns are ignored;
    an empty table gives an empty result.
    """
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = written(document_stats(docs).withColumn("base_failed", base), "stats")
    sound = stats.filter(~F.col("base_failed")).select("doc_id", "lang", "source", *STATS, *(z.alias(f"z{i}") for i, z in enumerate(vector())))
    rows = written(_cells(sound), "vectors")
    n_cells = rows.select("cell").distinct().count()
    judged = _with_estimates(rows, estimate(rows, n_cells), n_cells, "left").withColumn("distance", _distance())
    cut = chi2_quantile(1 - tail, P)
    out = ["doc_id", *STATS]
    return judged.select(*out, F.lit(False).alias("base_failed"), F.coalesce(F.col("distance") <= cut, F.lit(True)).alias("kept"), "distance", "cell").unionByName(
        stats.filter("base_failed").select(*out, "base_failed", F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"), F.lit(None).cast("string").alias("cell")))


def keep_sound(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``quality_verdicts`` keeps (by doc_id)."""
    kept = quality_verdicts(docs).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
