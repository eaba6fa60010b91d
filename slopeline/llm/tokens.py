"""Token ids of whole texts by a public byte-level BPE vocabulary (tokenizers library).

Plain texts (ASCII without apostrophes, Latin letters up to U+024F) are cut into the
vocabulary's pre-tokens with array operations; each distinct pre-token is encoded by the library
once a worker and looked up afterwards by a 64-bit hash. Any other text goes to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from .text import per_text, span_hashes, text_pieces

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
CLASS = np.full(256, _OTHER, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
CLASS[48:58] = _DIGIT
CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = _LETTER
#: Bytes that send a text to the library whole: apostrophes (contractions), separators between
#: controls and white space, and leads of code points outside U+00C0 to U+024F.
PLAIN = np.ones(256, bool)
PLAIN[[0x27, 0x1C, 0x1D, 0x1E, 0x1F, 0xC0, 0xC1, 0xC2, *range(0xCA, 0x100)]] = False


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of plain texts start: runs of letters, digits, other marks or white
    space, where one space before a run belongs to it and any other white space before a run
    stands alone."""
    kind = CLASS[data]
    start = np.ones(len(data), bool)
    start[1:] = kind[1:] != kind[:-1]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start |= cut[:-1]
    after = np.flatnonzero(start[1:] & (kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~cut[1:-1]) + 1
    start[after - 1] = True
    start[after[data[after - 1] == 32]] = False
    return np.flatnonzero(start)


def plain_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    bad = ~PLAIN[data]
    sign = (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    bad[:-1] |= sign
    return per_text(np.flatnonzero(bad), offsets) == 0


class Encoder:
    """Encodes text columns; ``encode`` yields one id array a row, with the end id appended."""

    MOST = 1 << 21  # distinct pre-tokens kept; beyond it the table starts anew (about 60 MB)

    def __init__(self, path: str, end_id: int = 0):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.end_id = end_id
        self.line_id = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._clear()

    def _clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((i for ids in each for i in ids), self.dtype, int(sizes.sum()))
        return flat, sizes

    def _words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of each pre-token. Those without a line feed are encoded many at
        a time, one a line: a line feed always stands alone before and after them."""
        lines = [w for w in words if not w.isspace()]
        texts = [b"\n".join(lines[k : k + 2000]).decode("utf-8") + "\n" for k in range(0, len(lines), 2000)]
        ids = np.concatenate([np.zeros(0, self.dtype), *(np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False))])
        ends = np.flatnonzero(ids == self.line_id)
        sizes = np.diff(ends, prepend=-1) - 1
        flat = ids[ids != self.line_id]
        if len(lines) == len(words):
            return flat, sizes
        own, own_sizes = self._batch([w.decode("utf-8") for w in words if w.isspace()])
        blank = np.fromiter((w.isspace() for w in words), bool, len(words))
        every = np.empty(len(words), np.int64)
        every[blank], every[~blank] = own_sizes, sizes
        out = np.empty(len(flat) + len(own), self.dtype)
        is_own = np.repeat(blank, every)
        out[is_own], out[~is_own] = own, flat
        return out, every

    def _rows(self, distinct: np.ndarray, spell) -> np.ndarray:
        """The table row of each distinct pre-token hash, encoding those not yet known."""
        if len(self.known) > self.MOST:
            self._clear()
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            flat, sizes = self._words(spell(np.flatnonzero(new)))
            rows = np.arange(len(sizes)) + len(self.first) - 1
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, flat])
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.place = known[order], np.concatenate([self.place, rows])[order]
            at = np.searchsorted(self.known, distinct)
        return self.place[at]

    def encode(self, column):
        """One array of ids a row (null is empty), each ending with the end id."""
        for lo, hi, data, offsets in text_pieces(column, 1 << 20):
            plain = plain_texts(data, offsets)
            starts = pretoken_starts(data, offsets)
            ends = np.append(starts[1:], len(data))
            counts = per_text(starts, offsets)
            if not plain.all():
                use = np.repeat(plain, counts)
                starts, ends, counts = starts[use], ends[use], np.where(plain, counts, 0)
            hashes = span_hashes(data, starts, ends)
            distinct, back = np.unique(hashes, return_inverse=True)
            sample = np.empty(len(distinct), np.int64)
            sample[back] = np.arange(len(back))
            raw = data.tobytes()
            rows = self._rows(distinct, lambda w: [raw[a:b] for a, b in zip(starts[sample[w]].tolist(), ends[sample[w]].tolist())])[back]
            sizes = self.first[rows + 1] - self.first[rows]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            source = np.repeat(self.first[rows] - upto[:-1], sizes) + np.arange(upto[-1])
            bounds = upto[np.concatenate([[0], np.cumsum(counts)])]
            per = np.diff(bounds)
            out = np.full(int(upto[-1]) + len(per), self.end_id, self.dtype)
            out[np.arange(upto[-1]) + np.repeat(np.arange(len(per)), per)] = self.ids[source]
            bounds = bounds + np.arange(len(bounds))
            for k in range(hi - lo):
                if plain[k]:
                    yield out[bounds[k] : bounds[k + 1]]
                else:
                    ids, _ = self._batch([raw[offsets[k] : offsets[k + 1]].decode("utf-8")])
                    yield np.append(ids, self.dtype(self.end_id))


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int = 0) -> Encoder:
    """The worker's encoder for a vocabulary file; its table of pre-tokens lasts over tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]
