"""Near-duplicate vectors against brute force."""

import math

import numpy as np
import pytest

from slopeline.llm.queries import QUERIES
from slopeline.llm.shared import table
from slopeline.llm.vectors import Grid, multi_sequence, near_vectors, unit, visited_rows


def brute(rows, cosine=0.9):
    """{position: (n_links, component_id)}"""
    ok = [v is not None and i is not None and len(v) > 0 and all(e is not None and math.isfinite(e) for e in v) and any(e != 0 for e in v) for i, v in rows]
    x = [np.array(v, float) / np.abs(v).max() if o else None for (_, v), o in zip(rows, ok)]
    x = [None if v is None else v / np.sqrt((v * v).sum()) for v in x]
    near = {k: [m for m in range(len(rows)) if m != k and ok[k] and ok[m] and len(x[k]) == len(x[m]) and x[k] @ x[m] >= cosine] for k in range(len(rows))}
    out = {}
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for m in near[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        out[k] = (len(near[k]), min(ids) if ids else None)
    return out


def groups(seed=5, n=600, d=16):
    """Random vectors, chains of near copies, a large group of them and one vector many times."""
    rnd = np.random.default_rng(seed)
    out = []
    for k in range(n):
        v = rnd.normal(size=d)
        for _ in range(int(rnd.choice([1, 1, 1, 2, 5]))):
            out.append(v.copy())
            v = v + rnd.normal(size=d) * rnd.choice([0.0, 0.1, 0.25])
    centre = rnd.normal(size=d)
    out += [centre + rnd.normal(size=d) * 0.15 for _ in range(300)] + [centre * 2] * 100
    order = rnd.permutation(len(out))
    return [(int(k) * 7 + 3, [float(np.float32(e)) for e in out[p]]) for k, p in enumerate(order)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("kw", [{"stop": 0.2}, {"stop": 0.2, "block_rows": 40, "codes": 5}, {"stop": 0.2, "codes": 1}])
def test_exact_stop_finds_every_pair(spark, kw):
    rows = groups()
    want = brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(frame(spark, rows), **kw).collect()}
    assert got == {rows[k][0]: (*v, v[1] == rows[k][0]) for k, v in want.items()}


def test_calibrated_stop_reaches_its_recall(spark):
    rows = groups(seed=6)
    want = {rows[k][0]: v[0] for k, v in brute(rows).items()}
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(frame(spark, rows)).collect()}
    assert all(got[k] <= want[k] for k in want)
    assert sum(got.values()) >= 0.98 * sum(want.values())


def test_whole_table(spark, sf_small):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_small, "embeddings").collect()]
    want = {rows[k][0]: v for k, v in brute(rows).items()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op13_multi_index"](spark, sf_small).collect()}
    assert got == want


def test_odd_rows_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (9, [1.0, 0.0, 0.0]), (9, [1.0, 0.01, 0.0]), (9, [-1.0, 0.0, 0.0]), (10, [1e-30, 0.0]), (11, [3e38, 1e36]), (12, [1.0])]
    df = frame(spark, rows).selectExpr("*", "1 as cid", "'x' as v", "2 as component_id", "true as kept", "null as i")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df, stop=0.2).collect()), key=str)
    want = sorted(((i, n, c, i is None or i == c) for (i, _), (n, c) in zip(rows, (brute([*rows])[k] for k in range(len(rows))))), key=str)
    assert got == want
    assert near_vectors(df.filter("false")).collect() == []
    assert [tuple(r) for r in near_vectors(df.filter("vec_id = 4")).collect()] == [(4, 0, 4, True)]


def test_traversal_order_and_visited_rows():
    rnd = np.random.default_rng(2)
    x = unit(rnd.normal(size=200 * 8), np.full(200, 8), 8)
    grid, stop = Grid(x, 6), 0.15
    costs, (i, j) = grid.costs(x), grid.cells(x)
    occupied = np.zeros((6, 6), bool)
    occupied[i, j] = True
    rows = {}
    for row, some in visited_rows(costs, i, j, occupied, stop):
        for q in some:
            rows.setdefault(int(q), set()).add(row)
    for q in range(200):
        cells = list(multi_sequence(costs[0][q], costs[1][q], stop))
        assert [c[0] for c in cells] == sorted(c[0] for c in cells) and len({c[1:] for c in cells}) == len(cells)
        assert len(cells) == int((costs[0][q][:, None] + costs[1][q] <= stop).sum())
        assert rows[q] == {a for _, a, b in cells if occupied[a, b] and (a, b) >= (i[q], j[q])}
    # No vector of a cell is nearer than the cell's cost.
    gap = ((x[:, None] - x[None]) ** 2).sum(2)
    assert (costs[0][:, i] + costs[1][:, j] <= gap + 1e-9).all()
