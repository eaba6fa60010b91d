import math
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_corpus import corpus, lower, words

from slopeline.llm.lattice import Pieces, _spaced, lattice_scores
from slopeline.llm.tokens import vocabulary_path


@pytest.fixture(scope="module")
def small():
    return Pieces([bytes([k]) for k in range(256)] + [b" a", b" ab", b"ab", b"abc", b"bc", b" AB", b"a b"], list(range(263)))


def segmentations(word, known):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in known:
            for rest in segmentations(word[k:], known):
                yield [word[:k], *rest]


def test_forward_sums_all_segmentations(small):
    known = dict(zip(small.pieces, small.scores))
    assert b" AB" not in known and b"a b" not in known
    texts = [b"abc", b"ab", b"a", b"xyzabcab", b"abcabcabc"]
    flat, starts, sizes = _spaced(b"".join(texts), np.array([len(t) for t in texts]))
    got, uses = small.forward(flat, starts, sizes, np.ones(len(texts)))
    want, counts = [], Counter()
    for t in texts:
        every = [(s, math.exp(sum(known[p] for p in s))) for s in segmentations(b" " + t, known)]
        total = sum(p for _, p in every)
        want.append(math.log(total))
        for s, p in every:
            for piece in s:
                counts[piece] += p / total
    assert np.allclose(got, want)
    assert np.allclose([uses[k] for k in range(len(small.pieces))], [counts[p] for p in small.pieces])


def test_long_words_agree_with_the_array_form(small, monkeypatch):
    flat, starts, sizes = _spaced(b"abcabxab" * 4, np.array([32]))
    one, u1 = small.forward(flat, starts, sizes, np.array([2.0]))
    monkeypatch.setattr("slopeline.llm.lattice.LONG", 3)
    two, u2 = small.forward(flat, starts, sizes, np.array([2.0]))
    assert np.allclose(one, two) and np.allclose(u1, u2)


def test_probabilities_of_a_small_language_sum_to_one():
    p = Pieces([b" ", b"a", b" a", b"aa"], [0, 1, 2, 3])
    scores = np.exp(p.scores)
    assert scores.sum() == pytest.approx(1)


@pytest.mark.parametrize("chunk", [None, 3000])
def test_counts_and_base_against_brute_force(docs, no_docs, chunk, monkeypatch):
    if chunk:
        monkeypatch.setattr("slopeline.llm.lattice.CHUNK_BYTES", chunk)
        monkeypatch.setattr("slopeline.llm.lattice.BUCKET_BYTES", chunk)
    path = vocabulary_path("byte_bpe_50k.tiktoken")
    got = sorted(lattice_scores(docs, path, rounds=1).collect())
    count, held = Counter(), lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    for i, t in corpus():
        if not held(i):
            count.update([*words(lower(t)), "\n"])
    n, v = sum(count.values()), len(count)
    for r, (i, t) in zip(got, sorted(corpus(), key=lambda x: x[0])):
        w = [*words(lower(t)), "\n"]
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, held(i), len(w), sum(count[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert math.isfinite(r["score"]) and r["score"] < 0
    if not chunk:
        assert lattice_scores(no_docs, path, rounds=1).count() == 0


def test_rounds_raise_the_likelihood_of_the_training_texts(docs):
    path = vocabulary_path("byte_bpe_50k.tiktoken")
    totals = [lattice_scores(docs, path, rounds=k).filter("NOT held_out").agg({"score": "sum"}).first()[0] for k in (0, 1, 3)]
    assert totals[0] < totals[1] < totals[2]
