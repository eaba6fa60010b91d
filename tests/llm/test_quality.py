from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_corpus import corpus, words

from slopeline.llm import quality
from slopeline.llm.quality import FLOOR, P, chi2_cdf, chi2_quantile, keep_sound, quality_verdicts, statistics


def brute_stats(t):
    w = words(t)
    seen = Counter(zip(w, w[1:], w[2:]))
    inside = {j for k, g in enumerate(zip(w, w[1:], w[2:])) if seen[g] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


def test_counts_against_brute_force():
    texts = [t for _, t in corpus()] + ["# a\n# a\n a\n", "a a a a", "|" * 9, "x\x0by\x0cz", "é ü k"]
    assert [tuple(r) for r in statistics(pa.array(texts, pa.string())).tolist()] == [brute_stats(t) for t in texts]


def test_chi_squared():
    assert chi2_cdf(11.0705, 5) == pytest.approx(0.95, abs=1e-6)
    assert chi2_quantile(0.95, 5) == pytest.approx(11.0705, abs=1e-3)


def junk_corpus(n=300):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(n):
        w = [f"word{x}" for x in rng.integers(0, 900, int(rng.integers(60, 400)))]
        if k % 15 == 0:
            w = [x + "$$$" for x in w]
        rows.append((k, " ".join(w), None if k % 2 else "en", "a" if k % 3 else None))
    return rows


def brute_verdicts(x, cells, steps=30):
    """The same estimate by plain numpy: bins, starts, concentration steps and reweighting."""
    out = np.zeros(len(x))
    factor = quality.COVERAGE / chi2_cdf(chi2_quantile(quality.COVERAGE, P), P + 2)
    floor = np.array(FLOOR)

    def held(cov):
        """Every direction, in floors, varies by one at least."""
        width, turned = np.linalg.eigh(cov / np.outer(floor, floor))
        return turned @ np.diag(np.maximum(width, 1)) @ turned.T * np.outer(floor, floor)

    def dist(z, mean, cov):
        return np.einsum("ij,jk,ik->i", z - mean, np.linalg.inv(cov), z - mean)

    for c in set(cells):
        z = x[[k for k, v in enumerate(cells) if v == c]]
        q = np.percentile(np.round(z, 2), [25, 50, 75], axis=0)
        tries = []
        for mean, cov in ((q[1], np.diag(np.maximum(((q[2] - q[0]) / 1.349) ** 2, floor ** 2))), (z.mean(0), held(np.cov(z.T, bias=True)))):
            for _ in range(steps):
                bins = np.floor(16 * np.log2(np.maximum(dist(z, mean, cov), 1e-6)))
                edge = np.sort(bins)[int(np.ceil(quality.COVERAGE * len(z) - 1e-9)) - 1]
                near = z[bins <= edge]
                mean, cov = near.mean(0), held(factor * np.cov(near.T, bias=True))
            tries.append((np.linalg.slogdet(cov)[1], mean, cov))
        _, mean, cov = min(tries, key=lambda v: v[0])
        edge = chi2_quantile(0.975, P)
        near = z[dist(z, mean, cov) <= edge]
        final = held(0.975 / chi2_cdf(edge, P + 2) * np.cov(near.T, bias=True))
        out[[k for k, v in enumerate(cells) if v == c]] = dist(z, near.mean(0), final)
    return out


def test_estimates_against_plain_numpy_and_junk_is_rejected(spark):
    rows = junk_corpus()
    got = {r["doc_id"]: r for r in quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    s = np.array([brute_stats(t) for _, t, _, _ in rows], float)
    z = np.stack([np.log1p(s[:, 0]), np.log((s[:, 1] + 1) / s[:, 0]), np.log1p(10 * s[:, 2] / s[:, 0]), np.log1p(s[:, 3]), np.sqrt(s[:, 4] / s[:, 0])], 1)
    expected = brute_verdicts(z, [(a, b) for _, _, a, b in rows])
    assert np.allclose([got[k]["distance"] for k in range(len(rows))], expected, rtol=1e-6)
    assert all(got[k]["kept"] == (k % 15 != 0) for k in range(len(rows)))


def test_more_cells_than_a_broadcast_holds(spark, monkeypatch):
    df = spark.createDataFrame(junk_corpus(), "doc_id long, text string, lang string, source string")
    one = {r["doc_id"]: r["distance"] for r in quality_verdicts(df).collect()}
    monkeypatch.setattr(quality, "BROADCAST_CELLS", 1)
    two = {r["doc_id"]: r["distance"] for r in quality_verdicts(df).collect()}
    assert one.keys() == two.keys() and all(two[k] == pytest.approx(one[k], rel=1e-9) for k in one)


def test_nulls_small_groups_and_empty_tables(spark, docs, no_docs):
    out = quality_verdicts(docs).collect()
    assert len(out) == len(corpus())
    by = {r["doc_id"]: r for r in out}
    for i, t in corpus():
        r, (n, chars, sym, dup, rep) = by[i], brute_stats(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, sym, dup, rep)
        assert r["base_failed"] == (n < 50 or 100 * rep > 50 * n)
        assert not (r["base_failed"] and r["kept"])
    assert quality_verdicts(no_docs).count() == 0
    few = spark.createDataFrame([(1, "a b " * 3 + " ".join(f"v{k}" for k in range(70)), None, None)], "doc_id long, text string, lang string, source string")
    assert [r["kept"] for r in quality_verdicts(few).collect()] == [True]


def test_keep_sound_keeps_columns_and_rows_without_id(spark):
    rows = [(i, t, a, b, "x") for i, t, a, b in junk_corpus(120)] + [(None, junk_corpus(2)[1][1], "en", "a", "x")]
    kept = keep_sound(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, cell string"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "cell"]
    assert kept.filter("doc_id IS NULL").count() == 1 and kept.filter("doc_id % 15 = 0").count() == 0
