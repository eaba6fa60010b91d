"""Array kernels over whole texts: word and line spans, span hashes, word-window hashes.

All functions take the raw UTF-8 bytes of many texts laid end to end plus the text offsets,
as an Arrow string column stores them, so no Python object is made per word. Callers walk a
column in pieces of a few MB (``text_pieces``), which bounds the memory of a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: ASCII white space, the word separators of every operator here.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
#: Bytes that begin a code point.
LEAD = (np.arange(256) & 0xC0) != 0x80
#: ASCII upper case to lower case, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE_BYTES = 2 << 20
#: Bytes hashed at a time (five 8-byte values a byte).
SLICE_BYTES = 1 << 19
#: Spans up to this length have no two regular strings with equal sums of powers.
LONG_SPAN = 64

_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _byte_values(seed: int) -> np.ndarray:
    ids = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1B54A32D192ED03 % (1 << 64))
    return mix(ids) | np.uint64(1)


BYTE_VALUES = [_byte_values(s) for s in range(2)]


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        grown[0] = 1
        have = np.cumprod(grown, dtype=np.uint64)
        if n <= PIECE_BYTES + 1:  # a very long text gets arrays of its own
            _powers[base] = have
    return have[:n]


def text_column(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets (int64, one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def text_pieces(column, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive row ranges of about ``limit`` bytes: first row, end row, bytes, offsets from 0.

    A single longer text is a piece of its own; every row is in exactly one piece."""
    data, offsets = text_column(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes, never across two texts."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return spans(~SPACE[data], offsets)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the non-empty lines (split at the line feed alone)."""
    return spans(data != 10, offsets)


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many spans each text has."""
    return np.diff(np.searchsorted(starts, offsets))


def span_hasher(data: np.ndarray, seed: int = 0):
    """A function from starts and ends to 64-bit hashes of those spans of ``data``; a hash depends
    on the bytes of a span alone, not on where they stand."""
    n = len(data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[seed][data] * _power(_BASE, n), out=sums[1:])
    inverse = _power(_INVERSE, n + 1)

    def hashes(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (sums[ends] - sums[starts]) * inverse[starts]
        return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))

    return hashes


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hashes of ascending spans, slice by slice: a hash does not depend on where its span stands, so
    the working arrays stay near ``SLICE_BYTES`` long whatever the length of ``data``."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        first = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, first + SLICE_BYTES, "right")))
        out[lo:hi] = span_hasher(data[first : ends[hi - 1]], seed)(starts[lo:hi] - first, ends[lo:hi] - first)
        lo = hi
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``span_hashes`` with a cryptographic hash for spans longer than ``LONG_SPAN``: in powers modulo 2**64,
    long regular strings of two letters (Thue-Morse words and their opposites) have equal sums."""
    out = span_hashes(data, starts, ends)
    for k in np.flatnonzero(ends - starts > LONG_SPAN).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive word hashes (across texts too; mask those)."""
    total = len(words) - size + 1
    if total < 1:
        return np.zeros(0, np.uint64)
    out = np.empty(total, np.uint64)
    step = max(SLICE_BYTES // 8, size)
    for lo in range(0, total, step):
        part = words[lo : lo + step + size - 1]
        n = len(part)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(part * _power(_BASE, n), out=sums[1:])
        h = (sums[size:] - sums[: n + 1 - size]) * _power(_INVERSE, n + 1)[: n + 1 - size]
        out[lo : lo + n + 1 - size] = mix(h + np.uint64(size))
    return out


def whole_windows(counts: np.ndarray, size: int) -> np.ndarray:
    """Start positions of the windows that lie inside one text, given words per text."""
    total = int(counts.sum())
    if total < size:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    left = np.repeat(ends, counts) - np.arange(total)
    return np.flatnonzero(left >= size)


def covered(positions: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of ``size`` words starting at ``positions``."""
    change = np.bincount(positions, minlength=total + 1)[: total + 1]
    change = change - np.bincount(np.minimum(positions + size, total), minlength=total + 1)[: total + 1]
    return np.cumsum(change[:total]) > 0


def member(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in ``wanted`` (sorted, distinct, uint64).

    A bit table over some hash bits rejects nearly all others before the binary search."""
    if len(wanted) == 0 or len(keys) == 0:
        return np.zeros(len(keys), bool)
    bits = min(24, max(10, int(len(wanted)).bit_length() + 4))
    shift = np.uint64(64 - bits)
    table = np.zeros(1 << bits, bool)
    table[(wanted * np.uint64(_BASE)) >> shift] = True
    out = table[(keys * np.uint64(_BASE)) >> shift]
    at = np.flatnonzero(out)
    place = np.minimum(np.searchsorted(wanted, keys[at]), len(wanted) - 1)
    out[at] = wanted[place] == keys[at]
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal entry elsewhere."""
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return member(keys, np.unique(twice))


def salted(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Keys that are equal only within the same group."""
    return mix(keys ^ (groups.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
