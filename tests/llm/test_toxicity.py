import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from slopeline.llm.quality import chi2_quantile
from slopeline.llm.text import LOWER, span_hashes
from slopeline.llm.toxicity import FOLDS, LEVEL, PREFIXES, Chain, chance, features_of, fit_chain, fit_link, inputs_of, score_toxicity

BAD = ["idiot", "stupid", "grumphaft", "grumpig", "grumpling", "moron", "pathetic"]


def hash_of(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(span_hashes(LOWER[data], np.array([0]), np.array([len(data)]))[0])


def labelled(n=600, seed=2):
    rnd = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "to") for b in ("ba", "di", "fo", "ge", "hu")]
    rows = []
    for k in range(n):
        w = [rnd.choice(vocab) for _ in range(rnd.randint(20, 120))]
        toxic = k % 6 == 0
        if toxic:
            kind = rnd.choice([BAD[:2] + BAD[5:], BAD[2:5]])
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(kind).title())
        rows.append((k, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy_and_edge_cases(spark):
    rows = labelled()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9000, None, "x"), (9001, "", "x"), (None, "you idiot moron stupid", "x"), (9002, "idiot " * 20000, "x"), (0, rows[0][1], "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, y, i % 2, 1) for i, _, y in rows if i % 5] + [(5, None, 1, 1), (None, 1, 1, 1), (77777, 1, 0, 1)], "doc_id long, toxic int, quality int, text int")
    chain = fit_chain(docs, labels)
    assert chain.categories == ["low_quality", "toxic"] and [len(w) - len(chain.vocabulary) for w in chain.links] == [1, 2]
    got = {r["doc_id"]: r for r in score_toxicity(docs, chain).collect()}
    held = [(got[i]["toxic"], bool(y)) for i, _, y in rows if i % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert got[None]["toxic"] and got[9002]["toxic"] and not got[9000]["toxic"] and not got[9001]["toxic"]
    assert score_toxicity(docs.limit(0), chain).count() == 0
    assert fit_chain(docs, labels.limit(0)) is None
    assert not any(r["toxic"] for r in score_toxicity(docs, None).collect())


def test_later_links_see_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    first = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    y = np.column_stack([first, first])  # the second category equals the first
    folds = np.arange(400) % 5
    chain = Chain.fit(["a", "b"], np.arange(3, dtype=np.uint64), x, y, folds)
    seen = np.zeros(400)
    for f in range(5):
        w = fit_link(x[folds != f], y[folds != f, 0])
        seen[folds == f] = chance(x[folds == f] @ w[:-1] + w[-1])
    assert np.allclose(chain.links[1], fit_link(np.column_stack([x, seen]), y[:, 1]), atol=1e-4)
    row, feature = np.nonzero(x)
    p = chain.predict(400, row, feature, x[row, feature])
    assert np.allclose(p[:, 1], chance(np.column_stack([x, p[:, 0]]) @ chain.links[1][:-1] + chain.links[1][-1]))


def test_link_is_the_penalised_optimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(200, 4)), (rng.random(200) > 0.6).astype(float)
    w = fit_link(x, y, penalty=2.0)
    z = np.column_stack([x, np.ones(200)])
    assert np.allclose(z.T @ (chance(z @ w) - y) + np.array([2.0] * 4 + [1e-6]) * w, 0, atol=1e-4)


def test_features_are_words_and_beginnings():
    found, = features_of(pa.array(["Grumphaft! ok"]))
    assert {hash_of(w) for w in ("grumphaft", "grum", "grumph", "grumpha", "ok")} == set(found.tolist())
    vocabulary = np.sort(np.array([hash_of("ok"), hash_of("grum")], np.uint64))
    row, _, value = inputs_of(pa.array(["ok ok grumps", None]), vocabulary)
    assert sorted(value.tolist()) == pytest.approx(sorted([np.log1p(400 / 23), np.log1p(200 / 23)])) and not row.any()
    found, = features_of(pa.array(["Ñandúes"]))  # beginnings are cut between characters
    assert {hash_of(w) for w in ("Ñandúes", "Ñand", "Ñandúe")} == set(found.tolist())


def plain_features(text):
    out = {}
    for w in re.findall(r"[A-Za-z\u0080-\U0010ffff]+", text or ""):
        w = "".join(c.lower() if c < "\x80" else c for c in w)
        for f in {w, *(w[:n] for n in PREFIXES if len(w) > n)}:
            out[f] = out.get(f, 0) + 1
    return out, len(re.findall(r"[A-Za-z\u0080-\U0010ffff]+", text or ""))


def test_a_long_text_is_worked_through_in_slices():
    rnd = random.Random(5)
    stems = [f"{a}{b}" for a in ("Ñandú", "grump", "lore", "ka") for b in ("", "haft", "ig", "éx", "ling")]
    text = " ".join(rnd.choice(stems) + rnd.choice(["", "s", "es"]) for _ in range(600_000))  # several slices
    column = pa.array(["ok idiot", text, None, "ok"])
    found, words = plain_features(text)
    vocabulary = np.sort(np.array([hash_of(f) for f in found], np.uint64))
    tracemalloc.start()
    try:
        sets = features_of(column)
        row, feature, value = inputs_of(column, vocabulary)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(sets[1], vocabulary) and [len(s) for s in sets] == [3, len(vocabulary), 0, 1]
    assert set(row.tolist()) == {1} and value.tolist() == pytest.approx([np.log1p(200 * found[f] / (words + 20)) for f in sorted(found, key=hash_of)])
    assert peak < 25 * len(text.encode())  # 39 bytes a byte of text when hashed as a whole


def test_the_whole_query_against_a_plain_replay(spark):
    rows = labelled(300, seed=8)
    marks = {i: (int(i % 3 == 0 or y), y) for i, _, y in rows}
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - low, toxic) for i, (low, toxic) in marks.items()], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in score_toxicity(docs, fit_chain(docs, labels)).collect()}
    each = {i: plain_features(t) for i, t, _ in rows}
    df = {}
    for i, (found, _) in each.items():
        for f in found:
            df.setdefault(f, []).append(i)
    n, edge = len(rows), chi2_quantile(1 - LEVEL / len(df), 1)

    def chi2(ids, c):
        a, pos, m = sum(marks[i][c] for i in ids), sum(v[c] for v in marks.values()), len(ids)
        return n * (a * n - m * pos) ** 2 / (m * (n - m) * pos * (n - pos)) if m < n else 0

    telling = sorted((f for f, ids in df.items() if max(chi2(ids, 0), chi2(ids, 1)) >= edge), key=hash_of)
    ids = sorted(marks)
    x = np.array([[np.log1p(200 * each[i][0].get(f, 0) / (each[i][1] + 20)) for f in telling] for i in ids])
    folds = np.array([i * 0x9E3779B97F4A7C15 % (1 << 64) >> 32 for i in ids]) % FOLDS
    chain = Chain.fit(["a", "b"], np.array([hash_of(f) for f in telling], np.uint64), x, np.array([marks[i] for i in ids], float), folds)
    row, feature = np.nonzero(x)
    want = chain.predict(len(ids), row, feature, x[row, feature])
    assert len(telling) >= 5 and np.allclose([got[i] for i in ids], want, atol=1e-4)
