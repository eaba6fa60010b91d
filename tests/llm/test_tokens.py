import random
import zlib
from math import ceil

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from llm_corpus import corpus
from pyarrow import fs as pafs
from tokenizers import Tokenizer

from slopeline.llm.packing import Plan, pack_documents
from slopeline.llm.tokenfile import TokenFile, file_blocks, read_tokens, token_folder, write_tokens
from slopeline.llm.tokens import Encoder, vocabulary_path

ODD = ["", " ", "  a", "a  b\n\n c", "don't 's x", "a\tb \tc 1234 $$a1", "×a ÷", "été  ñ\n", "日本 語", "\n a", "a \n", " a b", "x\x1cy", "a\x00b", None, "<|endoftext|>", "1é2", "é" * 50,
       " x", "Ā ɏ", "a\n", "\n\n", " \n", "a \n b", "½ 2", "é"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(vocabulary_path())
    t.encode_special_tokens = True
    return lambda x: [*t.encode(x or "", add_special_tokens=False).ids, 0]


def test_encoder_equals_the_library(plain):
    rnd = random.Random(1)
    texts = ODD + [t for _, t in corpus()] + ["".join(rnd.choice("aB é\n\t1.$'ß×") for _ in range(rnd.randrange(30))) for _ in range(400)]
    encode = Encoder(vocabulary_path())
    for _ in range(2):  # the second time from the table
        assert [x.tolist() for x in encode.encode(pa.array(texts, pa.string()))] == [plain(x) for x in texts]
    encode.MOST = 10  # a table that starts anew
    assert [x.tolist() for x in encode.encode(pa.array(texts, pa.string()))] == [plain(x) for x in texts]


def test_files_round_trip(spark, docs, no_docs, plain):
    folder = token_folder(spark)
    manifest = write_tokens(docs, folder, vocabulary_path(), file_bytes=8000)
    assert manifest.count() > 3
    got = sorted((tuple(r) for r in read_tokens(manifest, folder, with_ids=True).collect()), key=lambda r: r[1])
    start, expected = 0, []
    for i, t in sorted(corpus(), key=lambda r: (r[0], r[1] or "")):
        ids = np.array(plain(t), "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    assert [(*r[:4], bytes(r[4])) for r in got] == expected
    assert {r["doc_id"] for r in read_tokens(manifest, folder, {4, 503}).collect()} == {4, 503}
    empty = token_folder(spark)
    assert read_tokens(write_tokens(no_docs, empty, vocabulary_path()), empty).count() == 0


def test_file_is_plain_zstd_and_only_wanted_frames_are_read(tmp_path, monkeypatch):
    monkeypatch.setattr("slopeline.llm.tokenfile.FRAME_BYTES", 1000)
    docs = [(k if k != 3 else None, np.arange(k, k + 200, dtype=np.uint16)) for k in range(20)]
    raw = b"".join(file_blocks(iter(docs), np.uint16, {"n_tokens": 0, "n_docs": 0}))
    (tmp_path / "t.zst").write_bytes(raw)
    every = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert every == b"".join(x.tobytes() for _, x in docs)
    f = TokenFile(pafs.LocalFileSystem(), str(tmp_path / "t.zst"))
    assert [x.tolist() for i, _, x in f.documents({7})] == [docs[7][1].tolist()] and f.frames_read == 1 and len(f.sizes) > 8
    broken = bytearray(raw)
    broken[20] ^= 1
    (tmp_path / "b.zst").write_bytes(bytes(broken))
    with pytest.raises(Exception):
        list(TokenFile(pafs.LocalFileSystem(), str(tmp_path / "b.zst")).documents())


def check_places(rows, capacity):
    fill = {}
    for length, seq, off in sorted(rows, key=lambda r: (r[1], r[2])):
        assert off == fill.get(seq, 0)
        fill[seq] = off + length
    assert not fill or max(fill.values()) <= capacity
    return len(fill)


@pytest.mark.parametrize("seed", range(8))
def test_plan_places_every_piece_and_is_near_the_bound(seed):
    rnd = random.Random(seed)
    lengths = [min(60, max(1, int(rnd.expovariate(1 / 18)))) for _ in range(rnd.choice([0, 1, 5, 300]))]
    counts = {n: lengths.count(n) for n in lengths}
    plan = Plan(60, counts)
    if not lengths:
        assert plan.n_bins == 0
        return
    find = plan.lookup()
    rows = [(n, *(int(v[0]) for v in find(np.array([n]), np.array([r])))) for n, c in counts.items() for r in range(c)]
    used = check_places(rows, 60)
    bound = max(ceil(sum(lengths) / 60), sum(n * 2 > 60 for n in lengths))
    assert used <= bound * 1.08 + 1


def test_large_pieces_are_matched_greedily():
    plan = Plan(10, {9: 1, 6: 2, 4: 3, 5: 2, 1: 1})
    assert plan.n_bins == 5  # 9+1, 6+4, 6+4, 5+5, 4


def test_packing_of_documents(docs, no_docs, plain):
    rows = pack_documents(docs, vocabulary_path(), capacity=512, with_ids=True).collect()
    check_places([(r["length"], r["sequence_id"], r["offset"]) for r in rows], 512)
    whole = {}
    for r in sorted(rows, key=lambda r: r["piece"]):
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        if r["piece"]:
            assert r["length"] == 512
        whole.setdefault((r["doc_id"]), []).append(r)
    once = {i: t for i, t in corpus() if sum(j == i for j, _ in corpus()) == 1}
    for i, t in once.items():
        assert b"".join(bytes(r["ids"]) for r in whole[i]) == np.array(plain(t), "<u4").tobytes()
        assert [r["start"] for r in whole[i]] == list(np.cumsum([0, *(r["length"] for r in whole[i][:-1])]))
    assert sum(r["length"] for r in rows) == sum(len(plain(t)) for _, t in corpus())
    assert pack_documents(no_docs, vocabulary_path()).count() == 0
