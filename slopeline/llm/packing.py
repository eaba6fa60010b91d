"""Best-fit packing of token sequences with matching of the large pieces.

Pieces above one third of the capacity fit at most two to a bin. They are matched first: from the
longest down, each with the longest other one that still fits beside it. The smaller pieces
then go, longest first, to the fullest bin that has room (best fit decreasing).

Only lengths matter for the plan, so it is made from the number of pieces of each length (at most
``capacity`` numbers) and kept in runs: so many equal bins take so many pieces of one length each.
The size of the plan depends on the capacity alone. Pieces find their place by their length and
their rank among pieces of that length; ranks come from counts per length and hash bucket, so a
length that a third of all pieces share is ranked in many tasks.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import text_batches, written
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Plan:
    """Runs (length, first rank, pieces, first bin, pieces a bin, offset in the bin)."""

    def __init__(self, capacity: int, counts: dict[int, int]):
        self.capacity, self.runs, self.n_bins = capacity, [], 0
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of bins (first, number)
        self.order: list[int] = []
        large = sorted(n for n in self.left if 3 * n > capacity)
        self._match(large)
        for n in sorted((n for n in self.left if 3 * n <= capacity), reverse=True):
            self._best_fit(n)

    def _open(self, gap: int, first: int, number: int) -> None:
        if number and gap:
            if gap not in self.gaps:
                bisect.insort(self.order, gap)
                self.gaps[gap] = []
            self.gaps[gap].append((first, number))

    def _place(self, length: int, first_bin: int, bins: int, each: int, offset: int) -> None:
        self.runs.append((length, self.used[length], bins * each, first_bin, each, offset))
        self.used[length] += bins * each
        self.left[length] -= bins * each

    def _new(self, bins: int) -> int:
        self.n_bins += bins
        return self.n_bins - bins

    def _match(self, large: list[int]) -> None:
        for n in reversed(large):
            while self.left[n]:
                k = bisect.bisect_right(large, min(n, self.capacity - n)) - 1
                while k >= 0 and not self.left[large[k]] or k >= 0 and large[k] == n and self.left[n] < 2:
                    k -= 1
                if k < 0:
                    bins = self.left[n]
                    first = self._new(bins)
                    self._place(n, first, bins, 1, 0)
                    self._open(self.capacity - n, first, bins)
                    break
                m = large[k]
                bins = self.left[n] // 2 if m == n else min(self.left[n], self.left[m])
                first = self._new(bins)
                if m == n:
                    self._place(n, first, bins, 2, 0)
                else:
                    self._place(n, first, bins, 1, 0)
                    self._place(m, first, bins, 1, n)
                self._open(self.capacity - n - m, first, bins)

    def _best_fit(self, n: int) -> None:
        while self.left[n]:
            k = bisect.bisect_left(self.order, n)
            if k == len(self.order):  # no room anywhere: new bins
                each = self.capacity // n
                self._open(self.capacity, self._new(max(1, self.left[n] // each)), max(1, self.left[n] // each))
                continue
            gap = self.order[k]
            first, number = self.gaps[gap].pop()
            if not self.gaps[gap]:
                del self.gaps[gap]
                self.order.pop(k)
            each = gap // n
            bins = min(number, self.left[n] // each)
            if bins:
                self._place(n, first, bins, each, self.capacity - gap)
                self._open(gap - each * n, first, bins)
            elif number:  # the last few share one bin
                each, bins = self.left[n], 1
                self._place(n, first, 1, each, self.capacity - gap)
                self._open(gap - each * n, first, 1)
            self._open(gap, first + bins, number - bins)

    def lookup(self):
        """A function from arrays of length and rank to bin and offset."""
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 6)
        begin = (runs[:, 0] << 44) + runs[:, 1]

        def find(length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            run = runs[np.searchsorted(begin, (length << 44) + rank, "right") - 1]
            step = rank - run[:, 1]
            return run[:, 3] + step // run[:, 4], run[:, 5] + step % run[:, 4] * length

        return find


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Token pieces of every whole text (null: only the end id): doc_id, piece, start, length,
    ids_crc32 and, if asked, ids. Longer documents are cut from the end, so the first piece may
    be shorter."""
    text_batches(docs.sparkSession)

    def run(batches):
        encode = encoder(vocabulary, end_id)
        for b in batches:
            out = {c.split()[0]: [] for c in PIECES.split(", ")} | ({"ids": []} if with_ids else {})
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encode.encode(b.column("text"))):
                wide, end = ids.astype("<u4"), len(ids) % capacity or capacity
                cuts = [0, *range(min(end, len(ids)), len(ids) + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    raw = wide[lo:hi].tobytes()
                    for name, value in (("doc_id", doc_id), ("piece", k), ("start", lo), ("length", hi - lo), ("ids_crc32", zlib.crc32(raw)), ("ids", raw)):
                        if name in out:
                            out[name].append(value)
            yield pa.RecordBatch.from_pydict({k: pa.array(v, {"ids": pa.binary(), "piece": pa.int32()}.get(k, pa.int64())) for k, v in out.items()})

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def ranked(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, 0 up to the number of rows with the same ``by``."""
    buckets = max(32, rows.count() // 100_000)
    salted = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = salted.groupBy(by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(by, "_bucket").orderBy(*order)
    numbered = salted.withColumn("_row", F.row_number().over(within) - 1)
    return numbered.join(firsts, [by, "_bucket"]).withColumn("rank", F.col("_first") + F.col("_row")).select(*rows.columns, "rank")


def pack(rows: DataFrame, capacity: int = 2048) -> DataFrame:
    """``rows`` (written pieces, each of 1 to ``capacity`` tokens) with sequence_id and offset.

    Rows that share a doc_id and piece are packed each on its own; null ids are ordinary; an empty
    table gives an empty result."""
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan = Plan(capacity, counts)
    find = plan.lookup()
    placed = ranked(rows, "length", ["doc_id", "piece", "ids_crc32"])
    kind = placed.drop("rank")
    names = kind.columns

    def run(batches):
        for b in batches:
            if b.num_rows:
                sequence, offset = find(b.column("length").to_numpy(), b.column("rank").to_numpy())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.schema.fields)
    return placed.withColumn("rank", F.col("rank").cast("long")).mapInArrow(run, schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most ``capacity`` tokens."""
    return pack(written(pieces(docs, vocabulary, capacity, end_id, with_ids), "pieces"), capacity)
