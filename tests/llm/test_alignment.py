"""Token alignment against a plain version that encodes whole texts one by one."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from slopeline.llm.alignment import align_tokens, byte_level
from slopeline.llm.queries import QUERIES
from slopeline.llm.shared import table
from slopeline.llm.tokens import vocabulary_path

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def plain_tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(vocabulary_path(A))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(B))
    back = byte_level()

    def spell_b(k):
        piece = two.id_to_piece(k)
        return bytes([int(piece[3:5], 16)]) if two.is_byte(k) else piece.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return [], []
        a = one.encode(" " + text, add_special_tokens=False).ids
        b = two.encode(text)
        spelled_a = [bytes(back[c] for c in one.id_to_token(k)) for k in a]
        spelled_b = [spell_b(k) for k in b]
        if b"".join(spelled_a) != (" " + text).encode() or b"".join(spelled_b) != (" " + text).encode():
            return [], []
        out = []
        for ids, spelled in ((a, spelled_a), (b, spelled_b)):
            at, spans = 0, []
            for k, s in zip(ids, spelled):
                spans.append((k, at, at + len(s)))
                at += len(s)
            out.append(spans)
        return out

    return tokens


def brute(texts):
    tokens = plain_tokens()
    each, count = [], Counter()
    for text in texts:
        a, b = tokens(text)
        links, j = [], 0
        for ka, lo, hi in a:
            while j and b[j - 1][2] > lo:
                j -= 1
            while j < len(b) and b[j][2] <= lo:
                j += 1
            k = j
            while k < len(b) and b[k][1] < hi:
                links.append((ka, b[k][0]))
                k += 1
        count.update(links)
        each.append((a, b, links))
    best = {}
    for (_, kb), n in count.items():
        best[kb] = max(best.get(kb, 0), n)
    rows = []
    for a, b, links in each:
        cuts = sorted({s[2] for s in a} & {s[2] for s in b})
        groups, ia, ib = [], 0, 0
        for hi in cuts:
            ja, jb = ia, ib
            while ja < len(a) and a[ja][2] <= hi:
                ja += 1
            while jb < len(b) and b[jb][2] <= hi:
                jb += 1
            groups.append(",".join(str(s[0]) for s in a[ia:ja]) + "|" + ",".join(str(s[0]) for s in b[ib:jb]))
            ia, ib = ja, jb
        rows.append((len(a), len(b), len(cuts), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), ";".join(groups)))
    return rows


TEXTS = ["hello  world ", "", None, " ", "   ", "a\nb\t c", "日本語𝄞x <s> </s>", "é́ ﬁ", "x▁y", "<|endoftext|> it's don't", "hello  world ", "🙂🙂 ok", "a" * 300, "ü" * 50 + " " * 40 + "z", "  \x1c'", "\x00 nul"]
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


def frame(spark, texts, ids=None):
    rows = [(k if ids is None else ids[k], t) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def aligned(df, **kw):
    return align_tokens(df, vocabulary_path(A), vocabulary_path(B), **kw)


@pytest.mark.parametrize("pairs", [1 << 20, 0])
def test_odd_texts_match_the_plain_version(spark, pairs):
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in aligned(frame(spark, TEXTS), broadcast_pairs=pairs).collect()}
    assert got == dict(enumerate(brute(TEXTS)))


def test_whole_table_matches_the_plain_version(spark, sf_small):
    docs = table(spark, sf_small, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {k: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for k, w in zip(texts, brute(list(texts.values())))}
    got = {r["doc_id"]: tuple(r[c] for c in (*COLUMNS[:6], "groups_sha256")) for r in QUERIES["op12_tokenizer_spans"](spark, sf_small).collect()}
    assert got == want


def test_a_text_longer_than_a_row_of_ids(spark):
    long = "grün straße 12 日本 " * 150_000  # 3.6 MB
    rows = {r["doc_id"]: r for r in aligned(frame(spark, [long, "grün straße"])).collect()}
    a, b, links, _, _, _, _ = brute([long[:0] + "grün straße 12 日本 "])[0]
    assert rows[0]["n_a"] > 150_000 * 5 and rows[0]["n_links"] == rows[0]["n_a"] + rows[0]["n_b"] - rows[0]["n_groups"]
    assert rows[1]["count_sum"] >= 150_000


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    df = frame(spark, ["so it is", "so it is", None, "x"], [5, 5, None, None]).withColumn("chunk", F.lit("c")).withColumn("groups", F.lit(1)).withColumn("pair", F.lit(None).cast("int"))
    rows = aligned(df).orderBy("doc_id", "n_a").collect()
    assert [r["doc_id"] for r in rows] == [None, None, 5, 5] and [r["n_a"] for r in rows] == [0, 1, 3, 3]
    assert rows[2] == rows[3] and rows[2]["count_sum"] >= 6
    assert aligned(df.filter("false")).collect() == []
