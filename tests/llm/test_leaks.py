import random

import pytest

from slopeline.llm import leaks
from slopeline.llm.leaks import Pattern, Searcher, benchmark_hits, budget, normalised, piece_bounds, without_hits


def distance(p, t):
    """Least edits between p and any part of t, by the quadratic table."""
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        cur = [i + 1]
        for j, x in enumerate(t):
            cur.append(min(prev[j] + (c != x), prev[j + 1] + 1, cur[j] + 1))
        prev = cur
    return min(prev)


def edited(rnd, p, n):
    q = list(p)
    for _ in range(n):
        k, r = rnd.randrange(len(q) + 1), rnd.random()
        if r < 0.3:
            q.insert(k, "x")
        elif q and r < 0.6:
            q.pop(min(k, len(q) - 1))
        elif q:
            q[min(k, len(q) - 1)] = "y"
    return "".join(q)


@pytest.mark.parametrize("seed", range(6))
def test_search_against_the_quadratic_table(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        item = normalised("".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 80)))) or "a"
        around = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(0, 60))) for _ in range(2)]
        text = normalised(around[0] + edited(rnd, item, rnd.randint(0, 10)) + around[1])
        best, k = distance(item, text), budget(len(item), 20)
        got = Searcher([(7, item)], 20).search(text)
        assert bool(got) == (best <= k and bool(text))
        if got:
            assert got[0][1] == best and distance(item, text[got[0][2]:got[0][3]]) == best


def test_pieces_cover_the_item():
    for m in range(1, 60):
        b = piece_bounds(m, budget(m))
        assert b[0] == 0 and b[-1] == m and len(b) == budget(m) + 2 and all(x < y for x, y in zip(b, b[1:]))


def test_matcher_on_wide_characters():
    assert Pattern("日本語テスト").best("xx日本テストyy", 2) == (1, 2, 7)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and\nthen runs away over the green hill"), (2, None), (3, ""), (None, "no id at all here"), (4, "Ein ganz anderer Satz mit vielen Wörtern")]


@pytest.mark.parametrize("block", [4 << 20, 60])
def test_hits_and_clean_rows(spark, no_docs, block, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(10, "foo the QUICK  brown fax jumps over the lazy dig and then runs away over the green hill bar"), (11, "The quick brown fox jumps"), (12, None), (13, ""),
            (14, "x" * 100_000 + " ein ganz anderer satz mit vielen wörtern"), (15, ITEMS[0][1] + " " + ITEMS[4][1]), (15, ITEMS[0][1] + " " + ITEMS[4][1]), (None, ITEMS[4][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in benchmark_hits(docs, items).collect()), key=str)
    assert got == sorted([(10, 1, 2), (14, 4, 0), (15, 1, 0), (15, 4, 0), (15, 1, 0), (15, 4, 0), (None, 4, 0)], key=str)
    clean = without_hits(docs, items)
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [11, 12, 13]
    assert benchmark_hits(docs, items.limit(0)).count() == 0 and without_hits(docs, items.limit(0)).count() == len(rows)
    assert benchmark_hits(no_docs, items).count() == 0


def test_items_without_an_id_are_searched(spark):
    item = "A question of the benchmark whose number was lost on the way"
    docs = spark.createDataFrame([(1, f"before {item} after"), (2, "nothing of the kind in here")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (5, "another item that occurs nowhere")], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["distance"]) for r in benchmark_hits(docs, bench).collect()] == [(1, None, 0)]
    assert [r["doc_id"] for r in without_hits(docs, bench).collect()] == [2]
