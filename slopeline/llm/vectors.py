"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into two halves, each with a codebook of its own (k-means on a bounded
sample); the pairs of codes form a product grid, and every vector is indexed in its cell. A query
visits cells in the order of their distance, as the multi-sequence traversal does: in each half the
distance of a code is how far the query stands before the boundary between that code's region and
its own, and the squares of both halves add up. No vector of a cell is nearer than that, so a stop
beyond 2 - 2 * cosine would be exact; the stop in use is the least one that found the target share
of the true neighbours of a sample of queries, compared by brute force with all vectors.

Equal vectors form one class first, and a pair is sought from the vector in the lower cell, so that
it is found and counted once. Candidates are verified by their cosine in double precision.

Layout. A query is sent once to each row of the grid that holds a cell it visits. Rows are cut into
blocks of members and blocks of queries of bounded size, so that a row of the grid that holds a third of
all vectors is spread over many groups. A group returns a count of links a vector and the edges of
a spanning forest, never its pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import written

#: Bounds of the samples: vectors that the codebooks are fitted on, and queries for the recall.
SAMPLE_VECTORS, SAMPLE_BYTES, SAMPLE_QUERIES = 20_000, 32 << 20, 1_000
#: Vectors a cell on average, and the most codes of a half.
CELL_VECTORS, MOST_CODES = 64, 512
#: Bytes of vectors in a block of members or of queries.
BLOCK_BYTES = 2 << 20
BINS = 256
#: The stop found on the sample times this, for neighbours farther out than any of the sample's.
MARGIN = 1.5
SALTS = 32

INDEX = "cid long, least long, copies long, dim int, x binary, i int, j int"
VISITS = "i int, cid long, copies long, dim int, x binary, ci int, cj int"
FOUND = "a long, b long, n long"


def unit(flat: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Unit vectors, filled up with zeros to ``width``."""
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    out /= np.abs(out).max(1, keepdims=True)  # large components must not overflow the norm
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def fit_codes(sample: np.ndarray, k: int, steps: int = 10) -> np.ndarray:
    """k-means by Lloyd's steps, starting from the first distinct rows; a code without rows stays."""
    _, first = np.unique(sample, axis=0, return_index=True)
    codes = sample[np.sort(first)[:k]].copy()
    for _ in range(steps):
        near = distances(sample, codes).argmin(1)
        counts = np.bincount(near, minlength=len(codes))
        sums = np.zeros_like(codes)
        np.add.at(sums, near, sample)
        codes[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return codes


def distances(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (codes * codes).sum(1) - 2 * (x @ codes.T)


class Grid:
    """The codebooks of both halves and the distance of a query from the cells."""

    def __init__(self, sample: np.ndarray, k: int):
        self.width, self.cut = sample.shape[1], -(-sample.shape[1] // 2)
        self.codes = [fit_codes(half, k) for half in (sample[:, : self.cut], sample[:, self.cut :])]
        self.apart = [np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 0)) for c in self.codes]

    def halves(self, x: np.ndarray):
        return x[:, : self.cut], x[:, self.cut :]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(distances(half, codes).argmin(1).astype(np.int32) for half, codes in zip(self.halves(x), self.codes))

    def costs(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared distance of each query from the boundary of each code's region, by half."""
        out = []
        for half, codes, apart in zip(self.halves(x), self.codes, self.apart):
            d = distances(half, codes)
            own = d.argmin(1)
            gap = d - d[np.arange(len(d)), own][:, None]
            width = 2 * apart[own]
            out.append(np.where(width > 0, gap / np.where(width > 0, width, 1), 0) ** 2)
        return out


def multi_sequence(first: np.ndarray, second: np.ndarray, stop: float) -> Iterator[tuple[float, int, int]]:
    """Cells (cost, i, j) of one query in the order of their cost, up to ``stop``."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(float(first[one[0]] + second[two[0]]), 0, 0)], {(0, 0)}
    while heap and heap[0][0] <= stop:
        cost, r, s = heapq.heappop(heap)
        yield cost, int(one[r]), int(two[s])
        for nr, ns in ((r + 1, s), (r, s + 1)):
            if nr < len(one) and ns < len(two) and (nr, ns) not in seen:
                seen.add((nr, ns))
                heapq.heappush(heap, (float(first[one[nr]] + second[two[ns]]), nr, ns))


def visited_rows(costs: list[np.ndarray], i: np.ndarray, j: np.ndarray, occupied: np.ndarray, stop: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row of the grid, queries that visit one of its occupied cells at or after their own).

    All queries' traversals at once: up to the stop, a traversal visits the cells of cost at most the stop."""
    first, second = costs
    for row in range(first.shape[1]):
        some = np.flatnonzero((i <= row) & (first[:, row] <= stop))
        if len(some) and occupied[row].any():
            reach = (second[some] <= stop - first[some, row][:, None]) & occupied[row]
            reach &= (i[some] < row)[:, None] | (np.arange(second.shape[1]) >= j[some][:, None])
            yield row, some[reach.any(1)]


def _vectors(column, width: int) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), width)


def _classes(rows: DataFrame) -> DataFrame:
    """One row per distinct vector: its number, least vec_id, copies and the salts of its rows."""
    grouped = rows.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.collect_set("salt").alias("salts"))
    return written(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")


def _indexed(classes: DataFrame, grid: Grid) -> DataFrame:
    width = grid.width

    def run(batches):
        for b in batches:
            v = b.column("v")
            x = unit(v.flatten().to_numpy(zero_copy_only=False), v.value_lengths().to_numpy(), width)
            i, j = grid.cells(x)
            yield pa.RecordBatch.from_arrays([b.column("cid"), b.column("least"), b.column("copies"), pa.array(v.value_lengths().to_numpy(), pa.int32()),
                                              pa.array([r.tobytes() for r in x], pa.binary()), pa.array(i), pa.array(j)], names=[c.split()[0] for c in INDEX.split(", ")])

    return written(classes.select("cid", "least", "copies", "v").mapInArrow(run, INDEX), "index")


def stop_cost(index: DataFrame, grid: Grid, cosine: float, target: float) -> float:
    """The least traversal cost within which ``target`` of the sampled queries' true neighbours lie,
    counted over pairs and as the mean over queries. Without any neighbour in the sample: the cost
    that a displacement of a random direction stays within (a mean of 2 / width of its square, times 8)."""
    exact = 2 - 2 * cosine
    rows = index.orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE_QUERIES).toArrow()
    q, q_id, q_dim = _vectors(rows.column("x"), grid.width), rows.column("cid").to_numpy(), rows.column("dim").to_numpy()
    costs = grid.costs(q)

    def run(batches):
        for b in batches:
            x = _vectors(b.column("x"), grid.width)
            near = (q @ x.T >= cosine) & (q_dim[:, None] == b.column("dim").to_numpy()) & (q_id[:, None] != b.column("cid").to_numpy())
            who, y = np.nonzero(near)
            cost = costs[0][who, b.column("i").to_numpy()[y]] + costs[1][who, b.column("j").to_numpy()[y]]
            bins = np.minimum(np.ceil(cost / exact * BINS), BINS).astype(np.int64)
            keys, n = np.unique(who * (BINS + 1) + bins, return_counts=True)
            yield pa.RecordBatch.from_pydict({"q": pa.array(keys // (BINS + 1)), "bin": pa.array(keys % (BINS + 1)), "n": pa.array(n.astype(np.int64))})

    # At most BINS + 1 rows a sampled query come back.
    found = index.select("cid", "dim", "x", "i", "j").mapInArrow(run, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return min(exact, exact * 16 / grid.width)
    table = np.zeros((len(q), BINS + 1))
    table[found.column("q").to_numpy(), found.column("bin").to_numpy()] = found.column("n").to_numpy()
    upto = table.cumsum(1)[table.sum(1) > 0]
    recall = np.minimum(upto.sum(0) / upto[:, -1].sum(), (upto / upto[:, -1:]).mean(0))
    return min(exact, MARGIN * exact * int(np.argmax(recall >= target - 1e-12)) / BINS)


class Forest:
    """Spanning edges of the links among numbered nodes, kept as labels."""

    def __init__(self, n: int):
        self.label, self.edges = np.arange(n), []

    def add(self, x: int, ys: np.ndarray) -> None:
        ys = ys[self.label[ys] != self.label[x]]
        if len(ys):
            roots, pick = np.unique(self.label[ys], return_index=True)
            self.edges += [(x, int(y)) for y in ys[pick]]
            self.label[np.isin(self.label, roots)] = self.label[x]


def _compare(rows: pa.Table, grid: Grid, cosine: float, stop: float) -> pa.Table:
    """Links between the queries and the members of one block pair."""
    col = {c: rows.column(c).to_numpy() for c in ("cid", "copies", "dim", "ci", "cj")}
    x, member = _vectors(rows.column("x"), grid.width), rows.column("member").to_numpy(zero_copy_only=False)
    row = rows.column("i")[0].as_py()
    costs = grid.costs(x)
    queries, members = np.flatnonzero(~member), np.flatnonzero(member)
    names, node = np.unique(col["cid"], return_inverse=True)
    forest, links = Forest(len(names)), np.zeros(len(names), np.int64)
    members = members[np.argsort(col["cj"][members], kind="stable")]
    spent = costs[0][queries, row]
    for j, lo, hi in zip(*_runs(col["cj"][members])):
        y = members[lo:hi]
        some = queries[spent + costs[1][queries, j] <= stop]
        before = (col["ci"][some] < row) | ((col["ci"][some] == row) & (col["cj"][some] <= j))
        some = some[before]
        for at in range(0, len(some), 1024):
            q = some[at : at + 1024]
            hits = (x[q] @ x[y].T >= cosine) & (col["dim"][q][:, None] == col["dim"][y])
            same = (col["ci"][q] == row) & (col["cj"][q] == j)
            hits &= ~same[:, None] | (col["cid"][q][:, None] < col["cid"][y])
            if hits.any():
                np.add.at(links, node[q], hits @ col["copies"][y])
                np.add.at(links, node[y], hits.T @ col["copies"][q])
                for r in np.flatnonzero(hits.any(1)):
                    forest.add(int(node[q[r]]), node[y[hits[r]]])
    some = np.flatnonzero(links)
    a = np.concatenate([names[some], names[[e[0] for e in forest.edges]]]) if forest.edges else names[some]
    b = [None] * len(some) + [int(names[e[1]]) for e in forest.edges]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(links[some].tolist() + [None] * len(forest.edges), pa.int64())})


def _runs(values: np.ndarray):
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(values)][: len(starts)]


def _links(index: DataFrame, grid: Grid, cosine: float, stop: float, block_rows: int) -> DataFrame:
    """(a, null, n): links of class a found in a block pair; (a, b, null): forest edges."""
    k, m = len(grid.codes[0]), len(grid.codes[1])
    occupied, in_row = np.zeros((k, m), bool), np.zeros(k, np.int64)
    for r in index.groupBy("i", "j").count().collect():  # at most one row a cell of the grid
        occupied[r["i"], r["j"]] = True
        in_row[r["i"]] += r["count"]

    def visit(batches, whole):
        for b in batches:
            x = _vectors(b.column("x"), grid.width)
            i, j = b.column("i").to_numpy(), b.column("j").to_numpy()
            for row, some in visited_rows(grid.costs(x), i, j, occupied, stop):
                rows = pa.array(np.full(len(some), row, np.int32))
                if not whole:
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([len(some)], pa.int64())], names=["i", "n"])
                elif len(some):
                    part = b.take(pa.array(some))
                    yield pa.RecordBatch.from_arrays([rows, *(part.column(c) for c in ("cid", "copies", "dim", "x", "i", "j"))], names=[c.split()[0] for c in VISITS.split(", ")])

    asked = np.zeros(k, np.int64)
    for r in index.select("x", "i", "j").mapInArrow(lambda it: visit(it, False), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        asked[r["i"]] = r["n"]
    sizes = index.sparkSession.createDataFrame(
        [(r, max(1, math.ceil(int(in_row[r]) / block_rows)), max(1, math.ceil(int(asked[r]) / block_rows))) for r in range(k)], "i int, m_blocks int, q_blocks int")
    # A block of members meets each block of the queries of its row of the grid: every pair once.
    members = index.select("i", "cid", "copies", "dim", "x", F.col("i").alias("ci"), F.col("j").alias("cj")).join(F.broadcast(sizes), "i")
    members = members.select("i", F.pmod(F.xxhash64("cid"), F.col("m_blocks")).alias("mb"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"), F.lit(True).alias("member"), "cid", "copies", "dim", "x", "ci", "cj")
    queries = index.select("cid", "copies", "dim", "x", "i", "j").mapInArrow(lambda it: visit(it, True), VISITS).join(F.broadcast(sizes), "i")
    queries = queries.select("i", F.explode(F.sequence(F.lit(0), F.col("m_blocks") - 1)).alias("mb"), F.pmod(F.xxhash64("cid"), F.col("q_blocks")).alias("qb"), F.lit(False).alias("member"), "cid", "copies", "dim", "x", "ci", "cj")
    both = members.withColumn("mb", F.col("mb").cast("int")).unionByName(queries.withColumn("qb", F.col("qb").cast("long")).withColumn("mb", F.col("mb").cast("int")))

    def compare(rows):
        return _compare(rows, grid, cosine, stop)

    return both.groupBy("i", "mb", "qb").applyInArrow(compare, FOUND)


def near_vectors(embeddings: DataFrame, cosine: float = 0.9, target: float = 1.0, block_rows: int | None = None, codes: int | None = None, stop: float | None = None) -> DataFrame:
    """One row per row of ``embeddings`` (vec_id, embedding): vec_id, n_links (other vectors of
    cosine >= ``cosine`` found), component_id (least vec_id reachable by links) and kept.

    Vectors that are null, empty, all zero, or hold a null or non-finite component link with
    nothing, and so do rows without a vec_id (their component is null, kept is true). Vectors of
    different lengths never link. Rows that share a vec_id count as vectors of their own, copies of a
    vector link with each other; an empty table gives an empty result; other columns are not read.
    ``codes`` and ``stop`` fix the codes of a half and the traversal's stop; a stop of
    2 - 2 * ``cosine`` finds every pair."""
    spark = embeddings.sparkSession
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    infinite = F.lit(float("inf"))
    sound = F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == infinite)) & F.exists("v", lambda e: e != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    good = rows.filter("sound").select("vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int").alias("salt"))
    lone = rows.filter("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    classes = _classes(good)
    size = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    if not size["n"]:
        return lone
    n, width = size["n"], size["width"]
    k = codes or min(MOST_CODES, max(1, math.ceil(math.sqrt(n / CELL_VECTORS))))
    sample = classes.orderBy(F.xxhash64("v"), "cid").select("v").limit(max(k, min(SAMPLE_VECTORS, SAMPLE_BYTES // (8 * width)))).toArrow().column("v").combine_chunks()
    grid = Grid(unit(sample.flatten().to_numpy(zero_copy_only=False), sample.value_lengths().to_numpy(), width), k)
    index = _indexed(classes, grid)
    stop = stop_cost(index, grid, cosine, target) if stop is None else stop
    found = written(_links(index, grid, cosine, stop, block_rows or max(256, BLOCK_BYTES // (8 * width))), "found")
    links = found.filter("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n"))
    labels = components(found.filter("b is not null").select("a", "b"))
    labelled = written(classes.select("cid", "least", "copies").join(links, "cid", "left").join(labels.withColumnRenamed("id", "cid"), "cid", "left")
                       .select("cid", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component")), "labelled")
    named = labelled.join(labelled.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("cid", "n_links", "component_id")
    # Rows meet their class by vector and salt: a vector that a third of all rows share is dealt to SALTS tasks.
    salted = classes.select("cid", "v", F.explode("salts").alias("salt")).join(named, "cid").drop("cid")
    linked = good.join(salted, ["v", "salt"]).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(lone)
