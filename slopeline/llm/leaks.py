"""Benchmark decontamination: approximate occurrences of test items by pigeonhole pieces.

Texts and items are lower-cased and their white space made single spaces. An item of m characters
may differ by k = 10 % of m edits. Cut into k + 1 pieces, an occurrence with at most k edits holds
one piece unchanged, at most k characters from its place; so all pieces are sought exactly in
one pass over a text (Aho-Corasick), and the surroundings of a hit are verified with Myers's
bit-parallel edit distance: first growing runs of pieces, each with its share of the edits, which
ends nearly all chance hits after a few characters, then the whole item.

Items are processed in blocks of bounded size; each block is one pass over the documents without a
shuffle, and its automaton is built once a worker.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_batches

#: Characters of items in a block; a longer single item is a block of its own.
BLOCK_CHARS = 4 << 20
PERCENT = 10

HITS = "doc_id long, item_id long, distance int, start long, end long"


def normalised(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(m: int, percent: int = PERCENT) -> int:
    return m * percent // 100


def piece_bounds(m: int, k: int) -> list[int]:
    """Bounds of k + 1 pieces of nearly equal length."""
    return [m * j // (k + 1) for j in range(k + 2)]


class Pattern:
    """Myers's bit-parallel matcher of one item."""

    def __init__(self, text: str):
        self.text, self.m = text, len(text)
        self.ones, self.top = (1 << self.m) - 1, self.m - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(text):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def scores(self, text, anchored: bool = False):
        """After each character, the least edits between the item and a part of ``text`` that
        ends there (``anchored``: that starts at its beginning)."""
        ones, top, get, carry = self.ones, self.top, self.masks.get, int(anchored)
        pv, mv, score = ones, 0, self.m
        for c in text:
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (ones & ~(xh | pv))
            mh = pv & xh
            score += (ph >> top & 1) - (mh >> top & 1)
            ph = (ph << 1 | carry) & ones
            mh = mh << 1 & ones
            pv = mh | (ones & ~(xv | ph))
            mv = ph & xv
            yield score

    def best(self, text: str, k: int) -> tuple[int, int, int] | None:
        """(edits, start, end) of the best part of ``text`` with at most ``k`` edits, the earliest
        end among equals; None if there is none."""
        least, end = k + 1, -1
        for at, score in enumerate(self.scores(text)):
            if score < least:
                least, end = score, at + 1
        if end < 0:
            return None
        back = Pattern(self.text[::-1])
        for n, score in enumerate(back.scores(text[max(0, end - self.m - k) : end][::-1], anchored=True)):
            if score == least:
                return least, end - n - 1, end
        return least, end, end


class Searcher:
    """The pieces of a block of items in one automaton."""

    MOST_PATTERNS = 50_000

    def __init__(self, items: list[tuple[int, str]], percent: int = PERCENT):
        import ahocorasick

        self.items, self.patterns, self.percent = items, {}, percent
        self.machine = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        self.bounds = [piece_bounds(len(text), budget(len(text), percent)) for _, text in items]
        for which, (_, text) in enumerate(items):
            for piece, (lo, hi) in enumerate(zip(self.bounds[which], self.bounds[which][1:])):
                places.setdefault(text[lo:hi], []).append((which, piece))
        for piece, at in places.items():
            self.machine.add_word(piece, (len(piece), at))
        if places:
            self.machine.make_automaton()
        self.empty = not places

    def _pattern(self, which: int, lo: int, hi: int) -> Pattern:
        if (which, lo, hi) not in self.patterns:
            if len(self.patterns) > self.MOST_PATTERNS:
                self.patterns.clear()
            self.patterns[which, lo, hi] = Pattern(self.items[which][1][lo:hi])
        return self.patterns[which, lo, hi]

    def _climbs(self, text: str, which: int, piece: int, at: int) -> bool:
        """Whether a piece found at ``at`` can belong to an occurrence: the runs of pieces above it
        in a binary tree, each with one edit less than it has pieces, must match around it. (A run
        of n pieces with at most n - 1 edits has a half with fewer edits than pieces, so the whole
        item is reached from at least one unchanged piece.)"""
        bounds = self.bounds[which]
        runs, lo, hi = [], 0, len(bounds) - 1
        while hi - lo > 1:
            runs.append((lo, hi))
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if piece < mid else (mid, hi)
        for lo, hi in reversed(runs[1:]):
            k, begin = hi - lo - 1, at - bounds[piece]
            part = text[max(0, begin + bounds[lo] - k) : max(0, begin + bounds[hi] + k)]
            if min(self._pattern(which, bounds[lo], bounds[hi]).scores(part), default=k + 1) > k:
                return False
        return True

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Parts of ``text``, by item, where an occurrence may lie; overlapping ones joined."""
        found: dict[int, list[int]] = {}
        for end, (size, places) in self.machine.iter(text):
            for which, piece in places:
                start, k = end - size + 1 - self.bounds[which][piece], len(self.bounds[which]) - 2
                near = found.get(which)
                if near and any(abs(start - s) <= k for s in near[-4:]) or self._climbs(text, which, piece, end - size + 1):
                    found.setdefault(which, []).append(start)
        out = {}
        for which, starts in found.items():
            m, k = len(self.items[which][1]), len(self.bounds[which]) - 2
            joined: list[list[int]] = []
            for s in sorted(starts):
                lo, hi = max(0, s - k), min(len(text), s + m + k)
                if joined and lo <= joined[-1][1]:
                    joined[-1][1] = max(hi, joined[-1][1])
                else:
                    joined.append([lo, hi])
            out[which] = joined
        return out

    def search(self, raw: str | None, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, start, end) of each item's best occurrence in the normalised text."""
        text = normalised(raw)
        if self.empty or not text:
            return []
        out = []
        for which, parts in sorted(self.windows(text).items()):
            item_id, item = self.items[which]
            k, best = budget(len(item), self.percent), None
            for lo, hi in parts:
                if hi - lo < len(item) - k:
                    continue
                hit = self._pattern(which, 0, len(item)).best(text[lo:hi], k if best is None else best[0] - 1)
                if hit:
                    best = (hit[0], lo + hit[1], lo + hit[2])
                    if hit[0] == 0:
                        break
            if best:
                out.append((item_id, *best))
                if first:
                    break
        return out


_searchers: dict[str, Searcher] = {}


def item_blocks(benchmark: DataFrame):
    """Blocks of (item_id, normalised text) of bounded size; null and empty texts are left out,
    items without an id are not."""
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text IS NOT NULL")
    block, held = [], 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        text = normalised(row["text"])
        if not text:
            continue
        if block and held + len(text) > BLOCK_CHARS:
            yield block
            block, held = [], 0
        block.append((row["item_id"], text))
        held += len(text)
    if block:
        yield block


def _searcher(name: str, shared, percent: int) -> Searcher:
    if name not in _searchers:
        _searchers.clear()
        _searchers[name] = Searcher(shared.value, percent)
    return _searchers[name]


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document row and item that occurs in it: doc_id, item_id, distance, start and end
    (characters of the normalised text) of the best occurrence.

    Null and empty texts have none; an item without an id is reported with a null item_id; equal items are all reported; repeated rows are searched each;
    other columns are not read; an empty table on either side gives an empty result."""
    spark = docs.sparkSession
    text_batches(spark)
    rows, out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), None

    def searched(block):
        name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

        def run(batches):
            for b in batches:
                search = _searcher(name, shared, percent).search
                found = [(doc_id, *hit) for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")) for hit in search(text.as_py())]
                cols = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(cols)], names=["doc_id", "item_id", "distance", "start", "end"])

        return rows.mapInArrow(run, HITS)

    for block in item_blocks(benchmark):
        out = searched(block) if out is None else out.unionByName(searched(block))
    return spark.createDataFrame([], HITS) if out is None else out


def without_hits(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no item occurs."""
    spark = docs.sparkSession
    text_batches(spark)

    def cleaned(rows, block):
        name, shared = uuid.uuid4().hex, spark.sparkContext.broadcast(block)

        def run(batches):
            for b in batches:
                search = _searcher(name, shared, percent).search
                yield b.filter(pa.array(np.fromiter((not search(t.as_py(), first=True) for t in b.column("text")), bool, b.num_rows)))

        return rows.mapInArrow(run, rows.schema)

    for block in item_blocks(benchmark):
        docs = cleaned(docs, block)
    return docs
