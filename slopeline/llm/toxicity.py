"""Toxicity categories by a chain of linear classifiers.

The chain predicts its categories, columns of the labels, in order. Each link is a logistic regression over
the uses of words and word beginnings and the probabilities of all earlier categories. While fitting, those
probabilities are out-of-fold predictions, so that a later link sees earlier ones as uncertain as they will
be on new documents; the final links are fitted on all sampled rows.

Fitting uses a bounded sample of labelled rows (``SAMPLE_ROWS``, by a hash of doc_id). Its features
are all words and word beginnings that go with a category beyond chance: a chi-squared test, counted by
Spark over the sample, at a level of ``LEVEL`` over all features tested. Scoring reads every whole text in
one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import chi2_quantile
from .shared import give_back, text_batches, written
from .text import LEAD, LOWER, SLICE_BYTES, member, per_text, span_hasher, spans, text_pieces

SAMPLE_ROWS = 10_000
#: Bytes of an Arrow batch: a worker's pieces are 2 MB, and larger batches would only be held beside them, by both sides.
BATCH_BYTES = 4 << 20
#: Chance that a feature without any meaning is taken, over all features and for one category.
LEVEL = 0.01
#: Lengths of word beginnings, in characters.
PREFIXES = (4, 6, 7)
FOLDS = 5
#: The chain over the label columns: documents of low quality (0) first, then toxic ones (1).
CATEGORIES = {"low_quality": ("quality", 0), "toxic": ("toxic", 1)}
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """Words per text, and text and hash of each feature occurrence, slice by slice of about ``SLICE_BYTES``:
    the working arrays do not grow with a text. A word (a run of letters, A-Z lower-cased) is a feature, and
    so are its beginnings of ``PREFIXES`` characters: many languages build abuse from a stem and endings."""
    data = LOWER[data]
    starts, ends = spans(LETTER[data], offsets)
    counts = per_text(starts, offsets)

    def slices():
        lo = 0
        while lo < len(starts):
            first = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, first + SLICE_BYTES, "right")))
            part, begin, end = data[first : ends[hi - 1]], starts[lo:hi] - first, ends[lo:hi] - first
            owner, hashes = np.searchsorted(offsets, starts[lo:hi], "right") - 1, span_hasher(part)
            texts, found = [owner], [hashes(begin, end)]
            lead = np.append(np.flatnonzero(LEAD[part]), len(part))
            at = np.searchsorted(lead, begin)
            for n in PREFIXES:
                upto = lead[np.minimum(at + n, len(lead) - 1)]
                longer = upto < end
                texts.append(owner[longer])
                found.append(hashes(begin[longer], upto[longer]))
            yield np.concatenate(texts), np.concatenate(found)
            lo = hi

    return counts, slices()


def features_of(column) -> list[np.ndarray]:
    """The distinct features of each text."""
    out = []
    for lo, hi, data, offsets in text_pieces(column):
        each: list[list[np.ndarray]] = [[] for _ in range(hi - lo)]
        for owner, hashes in word_features(data, offsets)[1]:
            order = np.argsort(owner, kind="stable")
            owner, hashes = owner[order], hashes[order]
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for k, h in zip(owner[np.append(0, cuts)].tolist(), np.split(hashes, cuts)):
                each[k].append(np.unique(h))
        out += [np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64) for found in each]
    return out


def inputs_of(column, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature (by place in the sorted ``vocabulary``) and value of every input that is not zero: log
    of one plus the uses in 200 words. Twenty words are added to the text, so that one use in a very
    short text does not weigh more."""
    out, width = [], max(1, len(vocabulary))
    for lo, hi, data, offsets in text_pieces(column):
        words, slices = word_features(data, offsets)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for owner, hashes in slices:
            at = np.flatnonzero(member(hashes, vocabulary))
            found.append(np.unique(owner[at] * np.int64(width) + np.searchsorted(vocabulary, hashes[at]), return_counts=True))
        keys, place = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        uses = np.bincount(place, weights=np.concatenate([u for _, u in found]), minlength=len(keys))
        row, feature = np.divmod(keys, width)
        out.append((row + lo, feature, np.log1p(200 * uses / (words[row] + 20))))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


class Inputs:
    """Inputs of documents: those that are not zero, by row, and dense columns behind them; the last weight
    is the bias."""

    def __init__(self, n: int, f: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray, dense: np.ndarray | None = None):
        self.n, self.f, self.row, self.feature, self.value = n, f, row, feature, value
        self.dense = np.zeros((n, 0)) if dense is None else dense
        self.width = f + self.dense.shape[1] + 1

    @classmethod
    def of(cls, x) -> "Inputs":
        if isinstance(x, cls):
            return x
        row, feature = np.nonzero(x)
        return cls(*x.shape, row, feature, x[row, feature].astype(np.float64))

    def beside(self, dense: np.ndarray) -> "Inputs":
        return Inputs(self.n, self.f, self.row, self.feature, self.value, dense)

    def rows(self, some: np.ndarray) -> "Inputs":
        place, here = np.cumsum(some) - 1, some[self.row]
        return Inputs(int(some.sum()), self.f, place[self.row[here]], self.feature[here], self.value[here], self.dense[some])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.feature], minlength=self.n) + self.dense @ w[self.f : -1] + w[-1]

    def squares(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.feature, weights=self.value * self.value * r[self.row], minlength=self.f), (self.dense * self.dense).T @ r, [r.sum()]])

    def turned(self, r: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(self.feature, weights=self.value * r[self.row], minlength=self.f), self.dense.T @ r, [r.sum()]])


def fit_link(x, y: np.ndarray, penalty: float = 1.0, steps: int = 40) -> np.ndarray:
    """Weights and bias of an L2-penalised logistic regression, by Newton steps whose equations are solved
    by conjugate gradients (no matrix of features by features), each held back until the loss falls."""
    x = Inputs.of(x)
    ridge = np.full(x.width, penalty)
    ridge[-1] = 1e-6
    w = np.zeros(x.width)

    def loss(v):
        z = x.times(v)
        return np.logaddexp(0, z).sum() - z @ y + 0.5 * (ridge * v * v).sum()

    now = loss(w)
    for _ in range(steps):
        p = chance(x.times(w))
        gradient, weight = x.turned(p - y) + ridge * w, p * (1 - p)
        if np.abs(gradient).max() <= 1e-7 * max(1, x.n):
            break
        scale = x.squares(weight) + ridge  # the diagonal of the equations
        move, left = np.zeros_like(w), gradient.copy()
        eased = left / scale
        way, size = eased.copy(), left @ eased
        limit = min(0.01, np.sqrt(size) / max(1, x.n)) * size  # solved the better, the nearer the optimum
        for _ in range(200):
            if size <= limit:
                break
            bent = x.turned(weight * x.times(way)) + ridge * way
            share = size / (way @ bent)
            move += share * way
            left -= share * bent
            eased = left / scale
            before, size = size, left @ eased
            way = eased + size / before * way
        length, after = 1.0, loss(w - move)
        while after > now and length > 1e-6:
            length /= 2
            after = loss(w - length * move)
        if after > now:
            break
        w, now = w - length * move, after
    return w


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Chain:
    """Links for the categories in order; ``predict`` gives rows by categories."""

    def __init__(self, categories: Sequence[str], vocabulary: np.ndarray, links: list[np.ndarray]):
        self.categories, self.vocabulary, self.links = list(categories), vocabulary, links

    @classmethod
    def fit(cls, categories: Sequence[str], vocabulary: np.ndarray, x, y: np.ndarray, folds: np.ndarray, penalty: float = 1.0) -> "Chain":
        links, x = [], Inputs.of(x)
        earlier = np.zeros((x.n, 0))
        for c in range(len(categories)):
            inputs = x.beside(earlier)
            held = np.full(x.n, y[:, c].mean() if len(y) else 0.0)
            for f in np.unique(folds):
                out = folds == f
                if out.all():
                    continue
                held[out] = chance(inputs.rows(out).times(fit_link(inputs.rows(~out), y[~out, c], penalty)))
            links.append(fit_link(inputs, y[:, c], penalty))
            earlier = np.column_stack([earlier, held])
        return cls(categories, vocabulary, links)

    def predict(self, n: int, row: np.ndarray, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Probabilities, rows by categories, from the inputs that are not zero."""
        x, out = Inputs(n, len(self.vocabulary), row, feature, value), np.zeros((n, 0))
        for w in self.links:
            out = np.column_stack([out, chance(x.beside(out).times(w))])
        return out


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, int]] | None = None, sample_rows: int = SAMPLE_ROWS, level: float = LEVEL) -> Chain | None:
    """Fit the chain on labelled documents; None without any. ``categories``, in order, name a column of
    ``labels`` and the value that means the category.

    Rows with a null doc_id or label take no part; of several labels of a document, the one that means a category
    holds; of several texts of a document, the longest (then the greatest) is read throughout;
    labels without a document are ignored."""
    text_batches(docs.sparkSession, BATCH_BYTES)
    categories = CATEGORIES if categories is None else categories
    names = list(categories)
    marks = [F.when(F.col(c).isNotNull(), (F.col(c).cast("int") == v).cast("int")).alias(n) for n, (c, v) in categories.items()]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *marks).dropna().groupBy("doc_id").agg(*(F.max(n).alias(n) for n in names))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id")
    # Written once, one text a document: labels, features and inputs come from the same text.
    texts = written(texts.groupBy("doc_id", *names).agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("text")), "toxic-sample")

    def run(batches):
        for b in batches:
            found = features_of(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64())), *(b.column(n) for n in names)], names=["words", *names])
        give_back()

    totals = texts.agg(F.count(F.lit(1)).alias("n"), *(F.sum(n).alias(n) for n in names)).first()
    n = totals["n"]
    if not n:
        return None
    rows = texts.select("text", *names).mapInArrow(run, "words array<long>, " + ", ".join(f"`{c}` int" for c in names))
    counts = written(rows.select(F.explode("words").alias("word"), *names).groupBy("word").agg(F.count(F.lit(1)).alias("df"), *(F.sum(c).alias(c) for c in names)), "toxic-words")

    def chi2(c):
        """n (ad - bc)^2 over the product of the margins, for word and category."""
        a, df, pos = F.col(c).cast("double"), F.col("df").cast("double"), float(totals[c] or 0)
        return F.coalesce(n * F.pow(a * n - df * pos, 2) / F.nullif(df * (n - df) * F.lit(pos * (n - pos)), F.lit(0.0)), F.lit(0.0))

    edge = chi2_quantile(1 - level / max(1, counts.count()), 1)
    telling = counts.filter(F.greatest(*(chi2(c) for c in names)) >= edge).select("word").collect()  # bounded by the words of the sample
    vocabulary = np.sort(np.array([r["word"] for r in telling], np.int64).view(np.uint64))

    def encode(batches):
        for b in batches:
            row, feature, value = inputs_of(b.column("text"), vocabulary)
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(b.column(c) for c in names), pa.array([feature[i:j].astype(np.int32).tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary()),
                                              pa.array([value[i:j].tobytes() for i, j in zip(cuts, cuts[1:])], pa.binary())], names=["doc_id", *names, "features", "inputs"])
        give_back()

    encoded = texts.mapInArrow(encode, "doc_id long, " + ", ".join(f"`{c}` int" for c in names) + ", features binary, inputs binary")
    held = sorted(encoded.collect(), key=lambda r: r["doc_id"])  # at most sample_rows, their telling words alone
    sizes = [len(r["features"]) // 4 for r in held]
    x = Inputs(len(held), len(vocabulary), np.repeat(np.arange(len(held)), sizes), np.frombuffer(b"".join(r["features"] for r in held), np.int32), np.frombuffer(b"".join(r["inputs"] for r in held), np.float64))
    y = np.array([[float(r[c]) for c in names] for r in held])
    folds = np.array([r["doc_id"] * 0x9E3779B97F4A7C15 % (1 << 64) >> 32 for r in held]) % FOLDS
    return Chain.fit(names, vocabulary, x, y, folds)


def score_toxicity(docs: DataFrame, chain: Chain | None, threshold: float = 0.5) -> DataFrame:
    """One row per document row: doc_id, the probability of each category and ``toxic``, whether the
    last one reaches ``threshold``. Null and empty texts have no words; without a chain all
    probabilities are 0; repeated rows are scored alike; an empty table gives an empty result."""
    text_batches(docs.sparkSession, BATCH_BYTES)
    names = chain.categories if chain else list(CATEGORIES)

    def run(batches):
        for b in batches:
            p = chain.predict(b.num_rows, *inputs_of(b.column("text"), chain.vocabulary)) if chain else np.zeros((b.num_rows, len(names)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(p[:, k]) for k in range(len(names))), pa.array(p[:, -1] >= threshold)],
                                             names=["doc_id", *(f"p_{n}" for n in names), "toxic"])
        give_back()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"p_{n} double" for n in names) + ", toxic boolean")
