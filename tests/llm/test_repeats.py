import pytest
from llm_corpus import corpus, words

from slopeline.llm.repeats import level_lengths, remove_repeats


def brute(rows, size):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < i:
                gone[k:k + size] = [True] * size
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out, key=str)


def run(docs, **kw):
    rows = remove_repeats(docs, **kw).select("carry.doc_id", "n_words", "n_removed", "kept", "removed").collect()
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))
    return sorted([tuple(r)[:4] for r in rows], key=str)


def test_levels_double_and_end_at_the_size():
    assert level_lengths(13, 7) == [7, 13]
    assert level_lengths(50, 7) == [7, 14, 28, 50]
    assert level_lengths(5, 7) == [5]


@pytest.mark.parametrize("size,start", [(13, 7), (13, 3), (4, 7), (1, 1)])
def test_against_brute_force(docs, size, start):
    assert run(docs, size=size, start=start) == brute(corpus(), size)


def test_rows_without_id_come_last_as_one_document(spark):
    t = " ".join(f"v{k}" for k in range(20))
    rows = [(None, t), (None, t), (5, t)]
    out = run(spark.createDataFrame(rows, "doc_id long, text string"), size=13)
    assert [(r[0], r[2]) for r in out] == [(5, 0), (None, 20), (None, 20)]


def test_empty_table_and_carried_columns(docs, no_docs):
    assert run(no_docs) == []
    out = remove_repeats(docs, carry=docs.columns)
    assert out.select("carry.*").columns == docs.columns
    assert out.filter("carry.chunk = 'x' AND carry.bucket = 7").count() == len(corpus())


def test_many_chunks_and_buckets(docs, monkeypatch):
    monkeypatch.setattr("slopeline.llm.repeats.CHUNK_BYTES", 2000)
    monkeypatch.setattr("slopeline.llm.repeats.BUCKET_BYTES", 3000)
    assert run(docs, size=13) == brute(corpus(), 13)
