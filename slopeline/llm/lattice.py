"""Language-model scores by subword lattices.

An existing byte-level vocabulary gives the pieces; each has a unigram probability. A text is its
words, each with one space before it, then an end symbol; its probability is the sum over all
segmentations into pieces. No piece crosses a space, so the sum is a product over words, and a
word's sum comes from a forward recursion in log space over the pieces that match its bytes.
The vocabulary's merge order gives the first scores; rounds of expectation maximisation over the
training words re-estimate them.

Every word of the corpus takes part: chunks of documents send each distinct word once with its
training count, buckets of words merge the counts and answer with count and log probability.
Only piece scores (as many as the vocabulary has) pass through the driver.
"""

from __future__ import annotations

import base64
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import _slices, bucket_of, from_planes, planes
from .shared import parts, text_batches, total_bytes, written
from .text import _INVERSE, _BASE, BYTE_VALUES, LOWER, SPACE, _power, mix, per_text, span_hashes, text_column, word_spans

CHUNK_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
#: The end of a text, sent as a word that no text has.
END = b"\n"
#: Longer words are scored one by one.
LONG = 40
SMOOTHING = 0.1

ENTRIES = "bucket int, chunk int, words binary, lengths binary, counts binary"
WORDS = "bucket int, words binary, lengths binary, counts binary, n_tokens long, n_types long"
ANSWERS = "chunk int, bucket int, counts binary, scores binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Pieces:
    """The vocabulary's usable pieces and their natural-log probabilities (the end symbol last).

    Usable pieces are lower case and hold no white space but one leading space."""

    def __init__(self, pieces: list[bytes], ranks: list[int]):
        lower = [p.lower() == p and not any(SPACE[list(p[1:] if p[:1] == b" " else p)]) for p in pieces]
        self.pieces = [p for p, ok in zip(pieces, lower) if ok]
        rank = np.array([r for r, ok in zip(ranks, lower) if ok], np.float64)
        flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        ends = np.cumsum(sizes)
        hashes = span_hashes(flat, ends - sizes, ends)
        order = np.argsort(hashes)
        self.pieces, self.hashes, self.longest = [self.pieces[k] for k in order], hashes[order], int(sizes.max())
        weight = 1 / (rank[order] + 100)
        self.set_scores(np.append(weight, weight.sum() / 100))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.hashes >> np.uint64(44)] = True

    def set_scores(self, counts: np.ndarray) -> None:
        counts = counts + SMOOTHING
        self.scores = np.log(counts / counts.sum())

    @classmethod
    def from_ranks(cls, path: str) -> "Pieces":
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        return cls([base64.b64decode(a) for a, _ in rows], [int(b) for _, b in rows])

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces (positions), and which pieces."""
        at = np.flatnonzero(self.bits[hashes >> np.uint64(44)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        ok = self.hashes[place] == hashes[at]
        return at[ok], place[ok]

    def arcs(self, flat: np.ndarray, sums: np.ndarray, starts: np.ndarray, size: int):
        """All matches (i, j, words, pieces) in words of ``size`` bytes, by j then i."""
        inverse = _power(_INVERSE, len(flat) + 1)
        for j in range(1, size + 1):
            for i in range(max(0, j - self.longest), j):
                h = (sums[starts + j] - sums[starts + i]) * inverse[starts + i]
                h = mix(h ^ np.uint64((j - i) * 0x9FB21C651E98DF25 % (1 << 64)))
                at, piece = self.find(h)
                if len(at):
                    yield i, j, at, piece

    def forward(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weights: np.ndarray | None = None):
        """Log probability of each word (its bytes with the leading space). With ``weights``, also
        the expected number of uses of each piece, the end symbol last."""
        out = np.full(len(starts), -np.inf)
        uses = None if weights is None else np.zeros(len(self.scores))
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[0][flat] * _power(_BASE, len(flat)), out=sums[1:])
        known = None
        for size in np.unique(lengths).tolist():
            every = np.flatnonzero(lengths == size)
            if size > LONG:
                known = known or {p: k for k, p in enumerate(self.pieces)}
                for w in every.tolist():
                    out[w] = self._long(flat[starts[w] : starts[w] + size].tobytes(), known, None if weights is None else (uses, weights[w]))
                continue
            for lo in range(0, len(every), 20_000):
                at = every[lo : lo + 20_000]
                alpha = np.full((size + 1, len(at)), -np.inf)
                alpha[0] = 0
                seen = []
                for i, j, word, piece in self.arcs(flat, sums, starts[at], size):
                    alpha[j, word] = np.logaddexp(alpha[j, word], alpha[i, word] + self.scores[piece])
                    if uses is not None:
                        seen.append((i, j, word, piece))
                out[at] = alpha[size]
                if uses is not None:
                    beta = np.full((size + 1, len(at)), -np.inf)
                    beta[size] = 0
                    for i, j, word, piece in reversed(seen):
                        beta[i, word] = np.logaddexp(beta[i, word], beta[j, word] + self.scores[piece])
                        # beta[j] is whole: every arc from j comes later in the order by j
                    for i, j, word, piece in seen:
                        share = np.exp(alpha[i, word] + self.scores[piece] + beta[j, word] - alpha[size, word]) * weights[at][word]
                        uses += np.bincount(piece, weights=share, minlength=len(uses))
        return out if uses is None else (out, uses)

    def _long(self, word: bytes, known: dict[bytes, int], account=None) -> float:
        size = len(word)
        alpha, arcs = [0.0] + [-math.inf] * size, []
        for j in range(1, size + 1):
            terms = []
            for i in range(max(0, j - self.longest), j):
                piece = known.get(word[i:j])
                if piece is not None:
                    terms.append(alpha[i] + self.scores[piece])
                    if account is not None:
                        arcs.append((i, j, piece))
            top = max(terms)
            alpha[j] = top + math.log(sum(math.exp(x - top) for x in terms))
        if account is not None:
            beta = [-math.inf] * size + [0.0]
            for i, j, piece in reversed(arcs):
                beta[i] = float(np.logaddexp(beta[i], beta[j] + self.scores[piece]))
            for i, j, piece in arcs:
                account[0][piece] += account[1] * math.exp(alpha[i] + self.scores[piece] + beta[j] - alpha[size])
        return float(alpha[size])


def _spaced(words: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words end to end, each with a space before it: bytes, starts, lengths."""
    sizes = lengths.astype(np.int64) + 1
    starts = np.cumsum(sizes) - sizes
    flat = np.full(int(sizes.sum()), 32, np.uint8)
    mask = np.ones(len(flat), bool)
    mask[starts] = False
    flat[mask] = np.frombuffer(words, np.uint8)
    return flat, starts, sizes


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    n = ends - starts
    at = np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    return data[at].tobytes()


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


class Chunk:
    """The words of a chunk of documents; the distinct ones in hash order, the end symbol too."""

    def __init__(self, rows: pa.Table, buckets: int):
        self.ids = rows.column("id").to_pylist()
        self.held = np.fromiter(map(is_held_out, self.ids), bool, len(self.ids))
        data, offsets = text_column(rows.column("text"))
        self.data = np.concatenate([LOWER[data[offsets[0] : offsets[-1]]], np.frombuffer(END, np.uint8)])
        starts, ends = word_spans(self.data[:-1], offsets - offsets[0])
        self.counts = per_text(starts, offsets - offsets[0])
        owner = np.repeat(np.arange(len(self.ids)), self.counts)
        starts, ends = np.append(starts, len(self.data) - 1), np.append(ends, len(self.data))
        hashes = span_hashes(self.data, starts, ends)
        distinct, self.back = np.unique(hashes, return_inverse=True)
        sample = np.empty(len(distinct), np.int64)
        sample[self.back] = np.arange(len(self.back))
        self.starts, self.ends = starts[sample], ends[sample]
        self.train = np.bincount(self.back[:-1], weights=~self.held[owner], minlength=len(distinct)).astype(np.int64)
        self.train[self.back[-1]] = np.count_nonzero(~self.held)
        self.slices = _slices(bucket_of(distinct, buckets))


def _words_merged(rows: pa.Table) -> pa.Table:
    """The distinct words of a bucket with their summed counts, in hash order."""
    words, lengths = b"".join(rows.column("words").to_pylist()), np.concatenate([from_planes(b, np.uint32) for b in rows.column("lengths").to_pylist()]).astype(np.int64)
    counts = np.concatenate([from_planes(b, np.int64) for b in rows.column("counts").to_pylist()])
    data = np.frombuffer(words, np.uint8)
    ends = np.cumsum(lengths)
    hashes = span_hashes(data, ends - lengths, ends)
    distinct, back = np.unique(hashes, return_inverse=True)
    total = np.bincount(back, weights=counts, minlength=len(distinct)).astype(np.int64)
    sample = np.empty(len(distinct), np.int64)
    sample[back] = np.arange(len(back))
    return pa.table({"bucket": rows.column("bucket").slice(0, 1), "words": pa.array([_gather(data, (ends - lengths)[sample], ends[sample])], pa.binary()),
                     "lengths": pa.array([planes(lengths[sample].astype(np.uint32))], pa.binary()), "counts": pa.array([planes(total)], pa.binary()),
                     "n_tokens": pa.array([int(total.sum())]), "n_types": pa.array([int(np.count_nonzero(total))])})


def expected_uses(words: DataFrame, pieces: Pieces) -> np.ndarray:
    """Expected uses of each piece over the training words (one number a piece to the driver)."""

    def run(batches):
        for b in batches:
            uses = np.zeros(len(pieces.scores))
            for raw, packed, counted in zip(*(b.column(c).to_pylist() for c in ("words", "lengths", "counts"))):
                lengths, counts = from_planes(packed, np.uint32), from_planes(counted, np.int64)
                flat, starts, sizes = _spaced(raw, lengths)
                end = (lengths == 1) & (flat[np.minimum(starts + 1, len(flat) - 1)] == END[0])
                uses[-1] += counts[end].sum()
                some = (counts > 0) & ~end
                uses += pieces.forward(flat, starts[some], sizes[some], counts[some].astype(np.float64))[1]
            some = np.flatnonzero(uses)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(some, pa.int64()), "uses": pa.array(uses[some])})

    rows = words.select("words", "lengths", "counts").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
    out = np.zeros(len(pieces.scores))
    for r in rows:
        out[r["piece"]] = r["uses"]
    return out


def lattice_scores(docs: DataFrame, ranks_path: str, rounds: int = 2) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10 probabilities of the lower-cased words and the end; see the module).

    Documents whose crc32(doc_id as text) mod 10 is 0 are held out; a row without a doc_id counts as
    held out. Null and empty texts have the end alone. Repeated rows all count. With no training
    text the scores rest on smoothing alone; an empty table gives an empty result."""
    text_batches(docs.sparkSession)
    volume = total_bytes(docs, "text")
    n_chunks, buckets = parts(volume, CHUNK_BYTES), min(parts(volume, BUCKET_BYTES), 1 << 24)
    chunks = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(n_chunks)).cast("int").alias("chunk"),
                         F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def send(rows):
        c = Chunk(rows, buckets)
        sizes = (c.ends - c.starts).astype(np.uint32)
        return pa.table({"bucket": pa.array([b for b, _, _ in c.slices], pa.int32()), "chunk": pa.array([rows.column("chunk")[0].as_py()] * len(c.slices), pa.int32()),
                         "words": pa.array([_gather(c.data, c.starts[lo:hi], c.ends[lo:hi]) for _, lo, hi in c.slices], pa.binary()),
                         "lengths": pa.array([planes(sizes[lo:hi]) for _, lo, hi in c.slices], pa.binary()),
                         "counts": pa.array([planes(c.train[lo:hi]) for _, lo, hi in c.slices], pa.binary())})

    def merge(rows):
        return _words_merged(rows)

    entries = written(chunks.groupBy("chunk").applyInArrow(send, ENTRIES), "lm-entries")
    words = written(entries.groupBy("bucket").applyInArrow(merge, WORDS), "lm-words")
    totals = words.agg(F.sum("n_tokens").alias("n"), F.sum("n_types").alias("v")).first()
    n_train, n_types = totals["n"] or 0, totals["v"] or 0
    pieces = Pieces.from_ranks(ranks_path)
    for _ in range(rounds):
        pieces.set_scores(expected_uses(words, pieces))

    def answer(rows, merged):
        known, lengths = merged.column("words")[0].as_py(), from_planes(merged.column("lengths")[0].as_py(), np.uint32)
        counts = from_planes(merged.column("counts")[0].as_py(), np.int64)
        flat, starts, sizes = _spaced(known, lengths)
        hashes = span_hashes(flat, starts + 1, starts + sizes)  # ascending, as merged
        score = pieces.forward(flat, starts, sizes)
        score[(lengths == 1) & (flat[np.minimum(starts + 1, len(flat) - 1)] == END[0])] = pieces.scores[-1]
        out = {"counts": [], "scores": []}
        for raw, packed in zip(rows.column("words").to_pylist(), rows.column("lengths").to_pylist()):
            n = from_planes(packed, np.uint32).astype(np.int64)
            ends = np.cumsum(n)
            at = np.searchsorted(hashes, span_hashes(np.frombuffer(raw, np.uint8), ends - n, ends))
            out["counts"].append(planes(counts[at]))
            out["scores"].append(score[at].tobytes())
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "counts": pa.array(out["counts"], pa.binary()), "scores": pa.array(out["scores"], pa.binary())})

    def finish(rows, answers):
        c = Chunk(rows, buckets)
        replies = dict(zip(answers.column("bucket").to_pylist(), zip(answers.column("counts").to_pylist(), answers.column("scores").to_pylist())))
        count = np.concatenate([from_planes(replies[b][0], np.int64) for b, _, _ in c.slices])[c.back]
        score = np.concatenate([np.frombuffer(replies[b][1], np.float64) for b, _, _ in c.slices])[c.back] / math.log(10)
        base = np.log10((count + 0.1) / (n_train + 0.1 * (n_types + 1)))
        owner, n = np.repeat(np.arange(len(c.ids)), c.counts), len(c.ids)

        def per(x):
            return np.bincount(owner, weights=x[:-1], minlength=n) + x[-1]

        return pa.table({"doc_id": pa.array(c.ids, pa.int64()), "held_out": pa.array(c.held), "n_tokens": pa.array(c.counts + 1, pa.int64()), "n_known": pa.array(per(count > 0).astype(np.int64)),
                         "train_tokens": pa.array(np.full(n, n_train, np.int64)), "base_score": pa.array(per(base)), "score": pa.array(per(score))})

    answers = entries.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(answer, ANSWERS)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, SCORES)
