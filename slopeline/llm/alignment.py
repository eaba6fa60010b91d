"""Alignment of two tokenizers' tokens over the same texts.

A is a byte-level BPE of the tokenizers library, run on a space and the text; B is a sentencepiece
model, which puts that space before the text itself. Both token sequences spell the same bytes.

Spans. The libraries' own spans are the coarse cuts: character offsets of an encoding for A, the
spans of the sentencepiece proto for B (the immutable proto of older releases; the present library
returns it as ``proto``). Within a run that they leave open (a character that several byte-level
tokens share, byte-fallback tokens without a surface, the space put before the text) the decoded
bytes of each token refine the cut, and at every coarse cut both must agree. A text where they do
not, or whose joined bytes are not the text, has no tokens.

Neither vocabulary has a token across the boundary of a pre-token (A) or a token with a space after
another character (B, checked when the model is read), so each distinct word is encoded once a
worker, with its spans, and texts are put together from the table.

Layout. One pass encodes the documents and writes packed id arrays, some MB of text a row. Token
ends are running sums of the ids' byte lengths, so links and groups come from ids alone: the union
of both token ends cuts a text into its links, the common ends into its groups. The counts of id
pairs are one aggregation with map-side combining, bounded by the vocabularies and not by the
text. They are broadcast while there are few of them, and joined to the rows' distinct pairs beyond.
"""

from __future__ import annotations

import os
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import give_back, of_worker, text_batches, written
from .text import LEAD, per_text, span_hashes, text_pieces
from .tokens import plain_texts, pretoken_starts

#: Bytes of text in one written row; a longer text is a row of its own.
CHUNK_BYTES = 1 << 19
BATCH_BYTES = 4 << 20
#: The counts are broadcast up to this many id pairs (17 bytes each), and joined beyond.
BROADCAST_PAIRS = 2 << 20
#: Words that a library is given in one text.
WORDS_A_TEXT = 512
#: A worker's table of words starts anew beyond these numbers of words and of ids.
MOST_WORDS, MOST_IDS = 3 << 18, 1 << 22
#: New words are kept apart from the others, and merged in when they are more than this.
RECENT_WORDS = 1 << 16

CHUNKS = "chunk long, doc_ids binary, nulls binary, a binary, n_a binary, b binary, n_b binary, width int"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    characters stand for themselves, the other bytes for code points from 256 on, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def refined(ids, begins, ends, first, spelled, starts) -> tuple[np.ndarray, np.ndarray]:
    """The byte ends of the tokens of many words, and which words are spelled by their tokens.

    ``begins`` and ``ends`` are the library's spans in bytes, ``first`` the number of tokens before
    each word (one more than words), ``spelled`` the decoded length of each token, ``starts``
    where each word begins (one more than words)."""
    n = len(ids)
    sizes = np.diff(first)
    total = np.concatenate([[0], np.cumsum(spelled)])
    exact = total[1:] - np.repeat(total[first[:-1]], sizes) + np.repeat(starts[:-1], sizes)
    after = np.append(begins[1:], 0)
    closing = np.zeros(n, bool)
    closing[first[1:][sizes > 0] - 1] = True
    after[closing] = ends[closing]
    coarse = (ends > begins) & (after == ends)
    wrong = np.zeros(len(sizes), bool)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    wrong[owner[coarse & (exact != ends)]] = True
    last = np.where(sizes > 0, exact[np.maximum(first[1:] - 1, 0)] if n else 0, starts[:-1])
    wrong |= last != starts[1:]
    return np.where(coarse, ends, exact), ~wrong


def _runs_of(members: list[int]) -> list[list[int]]:
    return [members[k : k + WORDS_A_TEXT] for k in range(0, len(members), WORDS_A_TEXT)]


def _in_order(ids: list, spans: list, order: list[int], sizes: np.ndarray, words: list[bytes]):
    """Tokens found text by text for the words ``order``, put in the order of the words; spans within a word
    become spans within all words."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    within = np.concatenate(spans) if spans else np.zeros((0, 2), np.int64)
    order = np.array(order, np.int64)
    word = np.repeat(order, sizes[order])
    place = np.argsort(word, kind="stable")
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    within = within[place] + starts[word[place]][:, None]
    return flat[place], within[:, 0], within[:, 1], sizes


class WordTable:
    """Ids of distinct words, each encoded with its spans once a worker."""

    spell: list[bytes]

    def __init__(self):
        self.lengths = np.array([len(s) for s in self.spell], np.int64)
        self.dtype = np.uint16 if len(self.spell) <= 1 << 16 else np.uint32
        self.clear()

    def clear(self) -> None:
        self.known = [np.zeros(0, np.uint64)] * 2  # the table's words by hash, and recent ones
        self.place = [np.zeros(0, np.int32)] * 2
        self.first, self.ids, self.good = np.zeros(1, np.int64), np.zeros(0, self.dtype), np.zeros(0, bool)

    def spans(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, span begins and ends (bytes within the laid out words) and tokens a word."""
        raise NotImplementedError

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, tokens a word, and whether a word's tokens spell it."""
        starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        ids, begins, ends, sizes = self.spans(words)
        first = np.concatenate([[0], np.cumsum(sizes)])
        cuts, good = refined(ids, begins, ends, first, self.lengths[ids], starts)
        raw = b"".join(words)
        if b"".join(map(self.spell.__getitem__, ids.tolist())) != raw:
            bounds = np.concatenate([[0], cuts])
            for w in np.flatnonzero(good):
                spelled = b"".join(self.spell[i] for i in ids[first[w] : first[w + 1]].tolist())
                good[w] = spelled == words[w] and bounds[first[w + 1]] == starts[w + 1]
        return ids, sizes, good

    def look_up(self, hashes: np.ndarray, spell) -> np.ndarray:
        """The table row of each word hash; ``spell(k)`` gives the bytes of the k-th words."""
        distinct, sample, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known[0]) > MOST_WORDS or len(self.ids) > MOST_IDS:
            self.clear()
        rows, new = np.zeros(len(distinct), np.int64), np.ones(len(distinct), bool)
        for known, place in zip(self.known, self.place):
            if len(known):
                at = np.minimum(np.searchsorted(known, distinct), len(known) - 1)
                here = known[at] == distinct
                rows[here], new[here] = place[at[here]], False
        if new.any():
            ids, sizes, good = self.words(spell(sample[new]))
            rows[new] = np.arange(len(sizes)) + len(self.first) - 1
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            self.ids, self.good = np.concatenate([self.ids, ids.astype(self.dtype)]), np.concatenate([self.good, good])
            self.insert(1, distinct[new], rows[new].astype(np.int32))
            if len(self.known[1]) > RECENT_WORDS:
                self.insert(0, self.known[1], self.place[1])
                self.known[1], self.place[1] = self.known[1][:0], self.place[1][:0]
        return rows[back]

    def insert(self, k: int, words: np.ndarray, rows: np.ndarray) -> None:
        at = np.searchsorted(self.known[k], words)
        self.known[k], self.place[k] = np.insert(self.known[k], at, words), np.insert(self.place[k], at, rows)

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts end to end, tokens a text, and which texts their tokens spell."""
        starts = self.cuts(data, offsets)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(offsets) - 1, np.int64), np.ones(len(offsets) - 1, bool)
        ends = np.append(starts[1:], len(data))
        counts = per_text(starts, offsets)
        rows = self.look_up(span_hashes(data, starts, ends), lambda k: [data[a:b].tobytes() for a, b in zip(starts[k].tolist(), ends[k].tolist())])
        sizes = self.first[rows + 1] - self.first[rows]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self.first[rows] - upto[:-1], sizes) + np.arange(upto[-1])
        words = np.concatenate([[0], np.cumsum(counts)])
        bad = np.concatenate([[0], np.cumsum(~self.good[rows])])
        return self.ids[source], np.diff(upto[words]), np.diff(bad[words]) == 0


class ByteLevelTable(WordTable):
    """A: a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.line_id = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        byte_of = byte_level()
        self.spell = []
        for k in range(self.tokenizer.get_vocab_size()):
            entry = self.tokenizer.id_to_token(k) or ""
            self.spell.append(bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode("utf-8"))
        super().__init__()

    def spans(self, words):
        # A line feed always stands alone: words without one go to the library many at a time, one a line.
        single = [b"\n" in w or w.isspace() for w in words]
        ids, chars, sizes = [], [], np.zeros(len(words), np.int64)
        order, alone = [], [k for k, one in enumerate(single) if one]
        lines = [k for k, one in enumerate(single) if not one]
        for text, members in [*((words[k], [k]) for k in alone), *((b"\n".join(words[k] for k in part), part) for part in _runs_of(lines))]:
            encoded = self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False)
            found, spans = np.array(encoded.ids, np.int64), np.array(encoded.offsets, np.int64).reshape(-1, 2)
            # Character offsets to byte offsets, and to the words they lie in.
            data = np.frombuffer(text, np.uint8)
            lead = np.append(np.flatnonzero(LEAD[data]), len(data))
            spans = lead[spans]
            starts = np.concatenate([[0], np.cumsum([len(words[k]) + 1 for k in members])])
            if len(members) > 1:
                keep = found != self.line_id
                found, spans = found[keep], spans[keep]
            at = np.searchsorted(starts, spans[:, 0], "right") - 1
            sizes[members] = np.bincount(at, minlength=len(members))[: len(members)]
            ids.append(found)
            chars.append(spans - starts[at][:, None])
            order += members
        return _in_order(ids, chars, order, sizes, words)

    def cuts(self, data, offsets):
        starts = pretoken_starts(data, offsets)
        plain = plain_texts(data, offsets)
        if plain.all():
            return starts
        # Any other text goes to the library whole.
        keep = np.repeat(plain, per_text(starts, offsets))
        whole = offsets[:-1][~plain & (np.diff(offsets) > 0)]
        return np.union1d(starts[keep], whole)


_ID, _END = attrgetter("id"), attrgetter("end")


class PieceTable(WordTable):
    """B: a sentencepiece model. Words begin with their space, which the model puts there itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.spell = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode("utf-8") for k, p in enumerate(pieces)]
        self.split = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.model.piece_to_id("▁")
        super().__init__()

    def spans(self, words):
        # Words that end in another character than a space go to the library many at a time, as one text.
        marked = ["\u2581".encode() in w for w in words]  # read as a space: never spelled, and not encoded
        alone = [k for k, w in enumerate(words) if not marked[k] and (w[-1:] == b" " or not self.split)]
        joined = [k for k, w in enumerate(words) if not marked[k] and self.split and w[-1:] != b" "]
        ids, spans, order, sizes = [], [], [], np.zeros(len(words), np.int64)
        for members in [*([k] for k in alone), *_runs_of(joined)]:
            text = b"".join(words[k] for k in members)
            starts = np.concatenate([[0], np.cumsum([len(words[k]) for k in members])])
            if text == b" ":  # nothing after the space: the library gives no piece at all
                table = np.array([[self.space, 0, 1]], np.int64)
            else:
                proto = self.model.encode(text[1:].decode("utf-8"), return_type="proto")
                # Spans follow each other: one begins where the one before it ends.
                found = proto.pieces
                table = np.zeros((len(found), 3), np.int64)
                table[:, 0] = np.fromiter(map(_ID, found), np.int64, len(found))
                table[:, 2] = np.fromiter(map(_END, found), np.int64, len(found)) + 1
                table[1:, 1] = table[:-1, 2]
            at = np.searchsorted(starts, table[:, 1], "right") - 1
            sizes[members] = np.bincount(at, minlength=len(members))[: len(members)]
            ids.append(table[:, 0])
            spans.append(table[:, 1:] - starts[at][:, None])
            order += members
        return _in_order(ids, spans, order, sizes, words)

    def cuts(self, data, offsets):
        if not self.split:
            return offsets[:-1][np.diff(offsets) > 0]
        first = data == 32
        inner = first[1:] & ~first[:-1]
        first[1:] = inner
        first[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(first)


def _table(kind: type[WordTable], path: str) -> WordTable:
    return of_worker((kind.__name__, path), lambda: kind(path))


def _only(ids: np.ndarray, sizes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ids[np.repeat(keep, sizes)], np.where(keep, sizes, 0)


def _encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Packed ids of the documents, ``CHUNK_BYTES`` of text a row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        a_table, b_table = _table(ByteLevelTable, path_a), _table(PieceTable, path_b)
        number = TaskContext.get().partitionId() << 32
        held, volume = [], 0

        def close():
            nonlocal held, volume, number
            cols = [np.concatenate(c) for c in zip(*held)]
            held, volume, number = [], 0, number + 1
            ids = np.uint16 if a_table.dtype == b_table.dtype == np.uint16 else np.uint32
            kinds = (np.int64, bool, ids, np.int32, ids, np.int32)
            out = [pa.array([number - 1], pa.int64()), *(pa.array([c.astype(k).tobytes()], pa.binary()) for c, k in zip(cols, kinds)), pa.array([np.dtype(ids).itemsize], pa.int32())]
            del cols
            give_back()
            return pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in CHUNKS.split(", ")])

        for batch in batches:
            text = batch.column("text").fill_null("")
            spaced = pc.binary_join_element_wise(pa.scalar("", text.type), text, pa.scalar(" ", text.type)) if len(text) else text
            empty = pc.equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id")
            nulls = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_pieces(spaced, CHUNK_BYTES):
                a, n_a, good_a = a_table.encode(data, offsets)
                b, n_b, good_b = b_table.encode(data, offsets)
                keep = good_a & good_b & ~empty[lo:hi]
                held.append((ids[lo:hi], nulls[lo:hi], *_only(a, n_a, keep), *_only(b, n_b, keep)))
                volume += len(data)
                if volume >= CHUNK_BYTES:
                    yield close()
        if held:
            yield close()

    return rows.mapInArrow(run, CHUNKS)


class Links:
    """The links and groups of one written row, from its ids and the ids' byte lengths."""

    def __init__(self, row: dict, lengths_a: np.ndarray, lengths_b: np.ndarray):
        self.a, self.b = (np.frombuffer(row[c], f"u{row['width']}") for c in ("a", "b"))
        self.n_a, self.n_b = np.frombuffer(row["n_a"], np.int32).astype(np.int64), np.frombuffer(row["n_b"], np.int32).astype(np.int64)
        self.ids, self.nulls = np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["nulls"], bool)
        self.ends_a, self.ends_b = (np.cumsum(n[ids], dtype=np.int32) for n, ids in ((lengths_a, self.a), (lengths_b, self.b)))  # a text has less than 2 GB
        # Each piece between neighbouring cuts of either kind lies in one token of A and one of B.
        at_b = np.searchsorted(self.ends_a, self.ends_b)
        both = self.ends_a[np.minimum(at_b, max(0, len(self.ends_a) - 1))] == self.ends_b if len(self.ends_a) else np.zeros(0, bool)
        self.common = self.ends_b[both]
        ends = np.concatenate([self.ends_a, self.ends_b[~both]])
        ends.sort()
        self.ends = ends
        pairs = self.a[np.searchsorted(self.ends_a, ends)].astype(np.int64) << 32
        pairs |= self.b[np.searchsorted(self.ends_b, ends)]
        self.distinct, self.which, self.counts = np.unique(pairs, return_inverse=True, return_counts=True)

    def per_document(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        cuts = np.concatenate([[0], np.cumsum(self.n_a)])
        bytes_upto = np.concatenate([[0], self.ends_a])[cuts]
        return np.diff(total[np.searchsorted(self.ends, bytes_upto, "right")])

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document: decimal ids, groups in order."""
        tokens = np.concatenate([self.a, self.b]).astype(np.int32)
        group = np.concatenate([np.searchsorted(self.common, self.ends_a), np.searchsorted(self.common, self.ends_b)]).astype(np.int32)
        kind = np.repeat(np.array([0, 1], np.int8), [len(self.a), len(self.b)])
        order = np.argsort(group * np.int64(2) + kind, kind="stable")  # tokens of one kind stay in text order
        tokens, group, kind = tokens[order], group[order], kind[order]
        owner = np.concatenate([np.repeat(np.arange(len(n), dtype=np.int32), n) for n in (self.n_a, self.n_b)])[order]
        del order
        mark = np.zeros(len(tokens), np.int32)  # 0 a comma, 1 a bar, 2 a semicolon, 3 nothing
        mark[:-1][(group[1:] == group[:-1]) & (kind[1:] != kind[:-1])] = 1
        mark[:-1][group[1:] != group[:-1]] = 2
        mark[:-1][owner[1:] != owner[:-1]] = 3
        mark[-1:] = 3
        keys = tokens * 4 + mark
        met = np.zeros(int(keys.max(initial=0)) + 1, bool)
        met[keys] = True
        distinct = np.flatnonzero(met)
        spelled = np.empty(len(met), object)
        spelled[distinct] = [f"{t >> 2}{',|;'[t & 3] if t & 3 < 3 else ''}" for t in distinct.tolist()]
        flat = spelled[keys].tolist()
        cuts = np.concatenate([[0], np.cumsum(self.n_a + self.n_b)]).tolist()
        return ["".join(flat[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]

    def result(self, count: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        """``count`` and ``best`` by distinct pair."""
        links = self.per_document(np.ones(len(self.ends), np.int64))
        cols = [pa.array(self.ids, mask=self.nulls), self.n_a, self.n_b, self.n_a + self.n_b - links, links,
                self.per_document(best[self.which].astype(np.int64)), self.per_document(count[self.which]), pa.array(self.groups(), pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in RESULT.split(", ")])


def pair_counts(chunks: DataFrame, lengths_a: np.ndarray, lengths_b: np.ndarray) -> DataFrame:
    """(pair, n, best): links of each id pair in all texts, and whether no pair of its B id has more."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                links = Links(row, lengths_a, lengths_b)
                yield pa.RecordBatch.from_arrays([pa.array(links.distinct), pa.array(links.counts.astype(np.int64))], names=["pair", "n"])
            give_back()

    counts = written(chunks.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    # One row a B id: bounded by its vocabulary.
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return written(counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def align_tokens(docs: DataFrame, path_a: str, path_b: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per document row: doc_id, tokens of A and B, their groups and links, links whose pair
    is the most frequent of its B id (``n_best``, ties included), the sum of the links' counts, and the groups
    as text (``a1,a2|b1;a3|b2``).

    Null and empty texts, and texts that the tokens do not spell (such as one with U+2581, which
    sentencepiece reads as a space), have no tokens: zeros and an empty ``groups``. Rows without a
    doc_id or with a repeated one each count as a row of their own; an empty table gives an empty
    result; other columns are not read. A text is held whole by one task."""
    spark = docs.sparkSession
    text_batches(spark, BATCH_BYTES)
    chunks = written(_encoded(docs, path_a, path_b), "encoded")
    lengths_a, lengths_b = ByteLevelTable(path_a).lengths, PieceTable(path_b).lengths
    counts = pair_counts(chunks, lengths_a, lengths_b)
    if counts.count() <= broadcast_pairs:
        table = counts.toArrow().sort_by("pair")
        known = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

        def finish(batches):
            pair, n, best = known.value
            for batch in batches:
                for row in batch.to_pylist():
                    links = Links(row, lengths_a, lengths_b)
                    at = np.searchsorted(pair, links.distinct)
                    yield links.result(n[at], best[at])
                give_back()

        return chunks.mapInArrow(finish, RESULT)

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                links = Links(row, lengths_a, lengths_b)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(links.distinct), row["chunk"])), pa.array(links.distinct)], names=["chunk", "pair"])

    def answer(rows, answers):
        order = np.argsort(answers.column("pair").to_numpy())
        n, best = (answers.column(c).to_numpy()[order] for c in ("n", "best"))
        return pa.Table.from_batches([Links(rows.to_pylist()[0], lengths_a, lengths_b).result(n, best)])

    asked = chunks.mapInArrow(ask, "chunk long, pair long").join(counts, "pair").select("chunk", "pair", "n", "best")
    return chunks.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(answer, RESULT)
