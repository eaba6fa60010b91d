"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds whole documents in ascending doc_id order. Its parts:

* data frames: the ids (little endian, 16 or 32 bits each) of consecutive documents, about
  ``FRAME_BYTES`` a frame, each compressed on its own;
* one skippable frame with the document index (doc_id and number of ids, compressed);
* the seek table of the public zstd seekable format: for each frame its compressed and
  decompressed size and the low 32 bits of the XXH64 of its content, then frame count,
  descriptor and magic number at the very end.

A reader takes the end of the file, the index and then only the frames that hold the
documents it was asked for; every frame read is checked against its checksum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .shared import open_folder, parts, put_file, text_batches, total_bytes, written
from .tokens import encoder

FILE_BYTES = 24 << 20
FRAME_BYTES = 256 << 10
#: Fixed values of the zstd seekable format.
SKIPPABLE_INDEX = 0x184D2A50
SKIPPABLE_SEEK = 0x184D2A5E
SEEK_MAGIC = 0x8F92EAB1

MANIFEST = "number int, path string, n_docs long, n_tokens long, n_bytes long"


def file_blocks(documents: Iterator[tuple[int | None, np.ndarray]], dtype, totals: dict) -> Iterator[bytes]:
    """The bytes of one file, block by block; fills ``totals`` on the way."""
    press = zstandard.ZstdCompressor(level=3, write_content_size=True)
    ids, counts, frame, held, table = [], [], [], 0, []

    def close() -> bytes:
        raw = b"".join(frame)
        out = press.compress(raw)
        table.append((len(out), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        frame.clear()
        return out

    for doc_id, tokens in documents:
        raw = tokens.astype(dtype, copy=False).tobytes()
        if held and held + len(raw) > FRAME_BYTES:
            yield close()
            held = 0
        frame.append(raw)
        held += len(raw)
        ids.append(doc_id)
        counts.append(len(tokens))
        totals["n_tokens"] += len(tokens)
    if frame:
        yield close()
    known = np.array([i is not None for i in ids], np.uint8)
    index = press.compress(struct.pack("<QB", len(ids), np.dtype(dtype).itemsize) + known.tobytes()
                           + np.array([i or 0 for i in ids], "<i8").tobytes() + np.array(counts, "<u8").tobytes())
    yield struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
    table.append((len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
    entries = b"".join(struct.pack("<III", *e) for e in table)
    yield struct.pack("<II", SKIPPABLE_SEEK, len(entries) + 9) + entries + struct.pack("<IBI", len(table), 0x80, SEEK_MAGIC)
    totals["n_docs"] = len(ids)


class TokenFile:
    """Reads one file; ``documents`` gives chosen ones or all, decompressing only their frames."""

    def __init__(self, fs, path: str):
        self.source = fs.open_input_file(path)
        size = self.source.size()
        n, descriptor, magic = struct.unpack("<IBI", self.source.read_at(9, size - 9))
        if magic != SEEK_MAGIC or not descriptor & 0x80:
            raise ValueError(f"{path}: no seek table with checksums at its end")
        entries = np.frombuffer(self.source.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.raw_sizes, self.sums = entries.T
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_sizes)])
        index = zstandard.ZstdDecompressor().decompress(self.source.read_at(int(self.sizes[-1]) - 8, int(self.at[-2]) + 8))
        count, self.width = struct.unpack_from("<QB", index)
        known = np.frombuffer(index, np.uint8, count, 9)
        ids = np.frombuffer(index, "<i8", count, 9 + count)
        self.ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.counts = np.frombuffer(index, "<u8", count, 9 + 9 * count).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.frames_read = 0

    def frame(self, k: int) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(self.source.read_at(int(self.sizes[k]), int(self.at[k])), max_output_size=int(self.raw_sizes[k]))
        if len(raw) != self.raw_sizes[k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k}: content does not match the seek table")
        self.frames_read += 1
        return raw

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, ids of the file before it, and its ids."""
        last, raw = -1, b""
        for k, doc_id in enumerate(self.ids):
            if wanted is not None and doc_id not in wanted:
                continue
            begin = int(self.starts[k]) * self.width
            which = int(np.searchsorted(self.raw_at, begin, "right")) - 1
            if which != last:
                last, raw = which, self.frame(which)
            lo = begin - int(self.raw_at[which])
            yield doc_id, int(self.starts[k]), np.frombuffer(raw, f"<u{self.width}", int(self.counts[k]), lo)


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 0, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode every whole text and write it, ids and ``end_id``, to files in ``folder``.

    Returns the written manifest, one row a file in doc_id order, with ``start``, the ids in all
    files before it (a running sum over the manifest, one row per ``file_bytes`` of text). A null
    text is one end id; null doc_ids come first; rows that share a doc_id are all written, in
    text order; an empty table gives no files. A task run twice renames its own file into place.
    """
    text_batches(docs.sparkSession)
    n = parts(total_bytes(docs, "text"), file_bytes)
    rows = (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).repartitionByRange(n, F.col("doc_id"))
            .sortWithinPartitions(F.col("doc_id"), F.col("text")))

    def run(batches):
        encode = encoder(vocabulary, end_id)
        task = TaskContext.get()
        number, totals = task.partitionId(), {"n_tokens": 0, "n_docs": 0, "n_bytes": 0}

        def documents():
            for b in batches:
                yield from zip(b.column("doc_id").to_pylist(), encode.encode(b.column("text")))

        def sized():
            for block in file_blocks(first_and_rest, encode.dtype, totals):
                totals["n_bytes"] += len(block)
                yield block

        source = documents()
        head = next(source, None)
        if head is None:
            return

        def chained():
            yield head
            yield from source

        first_and_rest = chained()
        path = put_file(folder, f"tokens-{number:07d}.zst", sized(), f"{task.taskAttemptId()}")
        yield pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int32()), "path": [path], **{k: pa.array([totals[k]], pa.int64()) for k in ("n_docs", "n_tokens", "n_bytes")}})

    manifest = written(rows.mapInArrow(run, MANIFEST), "token-manifest")
    before = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str, doc_ids: set | None = None, with_ids: bool = False) -> DataFrame:
    """One row per document in the files: doc_id, start, n_tokens, ids_crc32 and, if asked, the ids
    (little-endian 32-bit). With ``doc_ids``, only the frames that hold those are decompressed."""

    def run(batches):
        fs, _ = open_folder(folder)
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                out = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []} | ({"ids": []} if with_ids else {})
                for doc_id, before, ids in TokenFile(fs, path).documents(doc_ids):
                    wide = ids.astype("<u4").tobytes()
                    for name, value in (("doc_id", doc_id), ("start", start + before), ("n_tokens", len(ids)), ("ids_crc32", zlib.crc32(wide)), ("ids", wide)):
                        if name in out:
                            out[name].append(value)
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})

    spread = manifest.select("path", "start").repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else ""))


def token_folder(spark) -> str:
    return scratch_path(spark, "tokens")
