"""Substring de-duplication by level-wise doubling over word windows.

Windows of a short length that occur in two documents are found first; only they are extended to
twice the length (the last step is shorter, so that it ends at the wanted length), and only those
repeated again go on. A window of the wanted length is removed from every document but the
one with the smallest doc_id.

Layout. Documents are grouped into chunks of about 2 MB by a hash of doc_id and text. A chunk sends each
distinct candidate window once, as packed arrays of hash remainders by bucket, however often it
occurs there: a passage that a third of all documents share is one entry a chunk. A bucket
answers each chunk with one bit an entry. Early levels use 32-bit remainders within a bucket (a
chance match costs work, never a result); the last level uses 96 bits and the least doc_id. The
text itself is shuffled once, and all levels run in one plan without caches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, parts, text_batches, total_bytes
from .text import SPACE, covered, member, per_text, repeated, span_hashes, text_column, whole_windows, window_hashes, word_spans

CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 8 << 20
#: A null doc_id counts as one document after all others.
NO_ID = np.iinfo(np.int64).max

ENTRIES = "bucket int, chunk int, keys binary, extra binary, ids binary"
REPLIES = "chunk int, level int, bucket int, bits binary"


def level_lengths(size: int, start: int) -> list[int]:
    """Window lengths of the levels: doubled from ``start``, ending at ``size``."""
    lengths = [min(start, size)]
    while lengths[-1] < size:
        lengths.append(min(2 * lengths[-1], size))
    return lengths


def planes(x: np.ndarray) -> bytes:
    """Integers by byte plane, so that the shuffle's compression finds the empty high bytes."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(b: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).reshape(-1).view(dtype)


def sorted_pack(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def sorted_unpack(b: bytes, dtype) -> np.ndarray:
    return np.cumsum(from_planes(b, dtype), dtype=dtype)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)


class Chunk:
    """The words of one chunk and, level by level, the windows that are still candidates."""

    def __init__(self, rows: pa.Table, lengths: Sequence[int], buckets: int):
        self.lengths, self.buckets = lengths, buckets
        ids = rows.column("id").combine_chunks()
        self.ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
        data, offsets = text_column(rows.column("text"))
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        self.starts, self.ends = word_spans(self.data, self.offsets)
        self.counts = per_text(self.starts, self.offsets)
        self.owner = np.repeat(self.ids, self.counts)
        self.words = [None, None]

    def hashes(self, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
        if self.words[seed] is None:
            self.words[seed] = span_hashes(self.data, self.starts, self.ends, seed)
        return window_hashes(self.words[seed], size)[at]

    def first(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Early level: key (bucket, 32-bit remainder) of each candidate, and its distinct keys."""
        h = self.hashes(at, self.lengths[level])
        keys = (bucket_of(h, self.buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        return keys, np.unique(keys)

    def several(self, keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The distinct keys that occur in two documents of this chunk."""
        twice = np.flatnonzero(repeated(keys))
        order = twice[np.lexsort((self.owner[at[twice]], keys[twice]))]
        k, d = keys[order], self.owner[at[order]]
        return np.unique(k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])])

    def last(self, at: np.ndarray):
        """Last level: candidates by (64 + 32 bits, doc_id), and where each distinct window begins."""
        h, low = self.hashes(at, self.lengths[-1]), self.hashes(at, self.lengths[-1], 1).astype(np.uint32)
        order = np.lexsort((self.owner[at], low, h))
        at, h, low = at[order], h[order], low[order]
        new = np.ones(len(at), bool)
        new[1:] = (h[1:] != h[:-1]) | (low[1:] != low[:-1])
        return at, h, low, np.flatnonzero(new)

    def survivors(self, replies: dict, upto: int) -> np.ndarray:
        """Candidate starts at level ``upto``, from the answers to the levels before it."""
        at = whole_windows(self.counts, self.lengths[0])
        for level in range(upto):
            keys, distinct = self.first(level, at)
            bits = self.bits(replies, level, distinct >> np.uint64(32), len(distinct))
            alive = np.zeros(len(self.starts) + 1, bool)
            alive[at[member(keys, distinct[bits])]] = True
            size, longer = self.lengths[level], self.lengths[level + 1]
            at = whole_windows(self.counts, longer)
            at = at[alive[at] & alive[at + longer - size]]
        return at

    @staticmethod
    def bits(replies: dict, level: int, bucket: np.ndarray, n: int) -> np.ndarray:
        """The bits of a level, put together in the order in which its entries were sent."""
        out = np.zeros(n, bool)
        names, firsts = np.unique(bucket, return_index=True)
        for b, lo, hi in zip(names.tolist(), firsts, [*firsts[1:], n]):
            packed = replies.get((level, b))
            if packed is not None:
                out[lo:hi] = np.unpackbits(np.frombuffer(packed, np.uint8), count=hi - lo).astype(bool)
        return out


def _replies(table: pa.Table) -> dict:
    cols = [table.column(c).to_pylist() for c in ("level", "bucket", "bits")]
    return {(lv, b): bits for lv, b, bits in zip(*cols)}


def _entries(bucket, chunk, keys, extra, ids) -> pa.Table:
    return pa.table({"bucket": pa.array(bucket, pa.int32()), "chunk": pa.array([chunk] * len(bucket), pa.int32()),
                     "keys": pa.array(keys, pa.binary()), "extra": pa.array(extra, pa.binary()), "ids": pa.array(ids, pa.binary())})


def _slices(bucket: np.ndarray):
    names, firsts = np.unique(bucket, return_index=True)
    return list(zip(names.tolist(), firsts, [*firsts[1:], len(bucket)]))


def _send_first(chunk: Chunk, number: int, level: int, replies: dict) -> pa.Table:
    at = chunk.survivors(replies, level)
    keys, distinct = chunk.first(level, at)
    both = chunk.several(keys, at)
    rows = _slices(distinct >> np.uint64(32))
    low = distinct.astype(np.uint32)
    marks = member(distinct, both)
    return _entries([b for b, _, _ in rows], number, [sorted_pack(low[lo:hi]) for _, lo, hi in rows],
                    [np.packbits(marks[lo:hi]).tobytes() for _, lo, hi in rows], [None] * len(rows))


def _answer_first(level: int, rows: pa.Table) -> pa.Table:
    keys = [sorted_unpack(b, np.uint32) for b in rows.column("keys").to_pylist()]
    marked = [k[np.unpackbits(np.frombuffer(m, np.uint8), count=len(k)).astype(bool)] for k, m in zip(keys, rows.column("extra").to_pylist())]
    every = np.sort(np.concatenate(keys))
    twice = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *marked])).astype(np.uint64)
    return _answers(rows, level, [member(k.astype(np.uint64), twice) for k in keys])


def _answers(rows: pa.Table, level: int, bits: list[np.ndarray]) -> pa.Table:
    some = [k for k, b in enumerate(bits) if b.any()]
    chunk, bucket = rows.column("chunk").to_pylist(), rows.column("bucket").to_pylist()
    return pa.table({"chunk": pa.array([chunk[k] for k in some], pa.int32()), "level": pa.array([level] * len(some), pa.int32()),
                     "bucket": pa.array([bucket[k] for k in some], pa.int32()),
                     "bits": pa.array([np.packbits(bits[k]).tobytes() for k in some], pa.binary())})


def _send_last(chunk: Chunk, number: int, replies: dict) -> pa.Table:
    at, h, low, new = chunk.last(chunk.survivors(replies, len(chunk.lengths) - 1))
    h, low, ids = h[new], low[new], chunk.owner[at[new]]
    rows = _slices(bucket_of(h, chunk.buckets))
    return _entries([b for b, _, _ in rows], number, [sorted_pack(h[lo:hi]) for _, lo, hi in rows],
                    [low[lo:hi].tobytes() for _, lo, hi in rows], [planes(ids[lo:hi]) for _, lo, hi in rows])


def _answer_last(level: int, rows: pa.Table) -> pa.Table:
    h = [sorted_unpack(b, np.uint64) for b in rows.column("keys").to_pylist()]
    cuts = np.cumsum([len(k) for k in h])[:-1]
    h = np.concatenate(h)
    low = np.concatenate([np.frombuffer(b, np.uint32) for b in rows.column("extra").to_pylist()])
    ids = np.concatenate([from_planes(b, np.int64) for b in rows.column("ids").to_pylist()])
    order = np.lexsort((ids, low, h))
    a, b, d = h[order], low[order], ids[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    least = d[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
    earlier = np.zeros(len(a), bool)
    earlier[order] = least < d
    return _answers(rows, level, np.split(earlier, cuts))


def removed_words(chunk: Chunk, replies: dict) -> np.ndarray:
    """Which words of the chunk lie in a window that an earlier document has."""
    at, h, low, new = chunk.last(chunk.survivors(replies, len(chunk.lengths) - 1))
    bits = chunk.bits(replies, len(chunk.lengths) - 1, bucket_of(h[new], chunk.buckets), len(new))
    which = np.cumsum(np.isin(np.arange(len(at)), new, assume_unique=True)) - 1 if len(at) else np.zeros(0, np.int64)
    least = chunk.owner[at[new]]
    gone = at[bits[which] | (least[which] < chunk.owner[at])]
    return covered(gone, chunk.lengths[-1], len(chunk.starts))


def _kept(chunk: Chunk, gone: np.ndarray, carry: pa.Array) -> pa.Table:
    n, text = len(chunk.ids), np.repeat(np.arange(len(chunk.ids)), chunk.counts)
    starts, ends, owner = chunk.starts[~gone], chunk.ends[~gone], text[~gone]
    # Kept words with one space after each but the last of a text.
    mask = np.zeros(len(chunk.data) + 1, np.int8)
    mask[starts] += 1
    mask[ends] -= 1
    mask = np.cumsum(mask, dtype=np.int8)[:-1].astype(bool) if len(mask) > 1 else np.zeros(0, bool)
    more = owner[1:] == owner[:-1]
    out = chunk.data.copy()
    out[SPACE[out]] = 32
    mask[ends[:-1][more]] = True
    sizes = np.bincount(owner, weights=ends - starts, minlength=n).astype(np.int64)
    words = np.bincount(owner, minlength=n)
    offsets = np.concatenate([[0], np.cumsum(sizes + np.maximum(words - 1, 0))])
    kept = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out[mask].tobytes()))
    # Runs of removed words within a text, as word positions.
    first = np.concatenate([[0], np.cumsum(chunk.counts)])
    lo, hi = (np.zeros(0, np.int64),) * 2 if not gone.any() else _runs(gone, first)
    owner = np.searchsorted(first, lo, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(lo - first[owner], pa.int64()), pa.array(hi - first[owner], pa.int64())], names=["start", "end"])
    cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
    return pa.table({"carry": carry, "n_words": pa.array(chunk.counts.astype(np.int64)),
                     "n_removed": pa.array((chunk.counts - words).astype(np.int64)), "kept": kept.cast(pa.string()) if offsets[-1] < 2**31 else kept,
                     "removed": pa.ListArray.from_arrays(pa.array(cuts), spans)})


def _runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    from .text import spans
    return spans(mask, offsets)


def remove_repeats(docs: DataFrame, size: int = 13, start: int = 7, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per document row: ``carry`` columns (in a struct), ``n_words``, ``n_removed``,
    ``kept`` (kept words joined by one space) and ``removed`` (word spans, end exclusive).

    A word goes when a window of ``size`` words over it also starts in a document with a smaller
    doc_id; repeats within one document stay. Windows are judged on the input. Null texts have
    no words; rows that share a doc_id count as one document, and so do rows without a doc_id,
    after all others. Columns other than doc_id, text and ``carry`` are not read.
    """
    text_batches(docs.sparkSession)
    lengths = level_lengths(size, start)
    volume = total_bytes(docs, "text")
    n_chunks, buckets = parts(volume, CHUNK_BYTES), min(parts(volume, BUCKET_BYTES), 1 << 24)
    # By id and text: many rows of one id are spread. Two rows of one document may then send a window
    # from two chunks; the early levels keep it as a candidate, and the last compares their ids.
    chunks = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(n_chunks)).cast("int").alias("chunk"), F.col("doc_id").cast("long").alias("id"),
                         F.col("text").cast("string").alias("text"), F.struct(*(F.col(c) for c in carry)).alias("carry"))

    def sender(level: int):
        """Entries of one level, from the chunk and the answers to the levels before it."""
        def resend(rows, answers):
            if not rows.num_rows:
                return _entries([], 0, [], [], [])
            chunk, number, known = Chunk(rows, lengths, buckets), rows.column("chunk")[0].as_py(), _replies(answers)
            out = _send_last(chunk, number, known) if level == len(lengths) - 1 else _send_first(chunk, number, level, known)
            give_back()
            return out

        def send(rows):
            return resend(rows, pa.table({"level": [], "bucket": [], "bits": []}))

        return resend if level else send

    def answerer(level: int):
        def answer(rows):
            return _answer_last(level, rows) if level == len(lengths) - 1 else _answer_first(level, rows)

        return answer

    replies = None
    for level in range(len(lengths)):
        own = chunks.groupBy("chunk")
        entries = own.cogroup(replies.groupBy("chunk")).applyInArrow(sender(level), ENTRIES) if level else own.applyInArrow(sender(0), ENTRIES)
        answers = entries.groupBy("bucket").applyInArrow(answerer(level), REPLIES)
        replies = replies.unionAll(answers) if level else answers

    def finish(rows, answers):
        chunk = Chunk(rows, lengths, buckets)
        carried = rows.column("carry").combine_chunks()
        out = _kept(chunk, removed_words(chunk, _replies(answers)), carried)
        give_back()
        return out

    kind = chunks.schema["carry"].dataType.simpleString()
    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        finish, f"carry {kind}, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>")
