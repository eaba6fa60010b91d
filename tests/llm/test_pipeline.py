"""The pipeline and every registered query of this subpackage, on the smallest tables."""

import pytest
from llm_corpus import lower, words
from pyspark.sql import functions as F

import corpus_pipeline
from slopeline.llm.queries import ORACLE, QUERIES
from slopeline.llm.shared import table, written
from slopeline.llm.tokens import vocabulary_path

SF = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__ as entry

    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def brute_components(rows, size, t):
    sets, label = {}, {}
    for i, text in rows:
        w = words(lower(text))
        sets[i], label[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}, i

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b >= a:
                break
            both = len(sets[a] & sets[b])
            if both and 100 * both >= t * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i for i in ids if root(i) == i}


@pytest.fixture(scope="module")
def stages(spark):
    out, docs = [], table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), name)
        out.append((docs, after))
        docs = after
    return out


def rows_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_and_chain(stages, spark):
    for before, after in stages[:-1]:
        assert after.columns == before.columns
    assert corpus_pipeline.run(spark, SF).count() == stages[-1][1].count()


def test_quality_stage(stages):
    from slopeline.llm.quality import quality_verdicts

    before, after = stages[0]
    assert set(rows_of(after)) == {r["doc_id"] for r in quality_verdicts(before).collect() if r["kept"]}
    assert all(len(words(t)) >= 50 for t in rows_of(after).values())


def test_jaccard_stage(stages):
    before, after = (rows_of(x) for x in stages[1])
    assert set(after) == brute_components(before.items(), 5, 80) and all(after[i] == before[i] for i in after)


def test_substring_stage(stages):
    before, after = (rows_of(x) for x in stages[2])
    first = {}
    for i in sorted(before):
        w = words(before[i])
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k:k + 13]), i)
    assert set(after) == set(before)
    for i, t in before.items():
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if first[tuple(w[k:k + 13])] < i:
                gone[k:k + 13] = [True] * 13
        assert after[i] == (" ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t)
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2][1].collect())


def test_decontamination_stage(stages, spark):
    def plain(t):
        return " ".join(t.lower().split())

    items = [plain(r["text"]) for r in table(spark, SF, "benchmark").collect()]
    before, after = (rows_of(x) for x in stages[3])
    exact = {i for i, t in before.items() if any(x in plain(t) for x in items)}
    gone = set(before) - set(after)
    assert exact <= gone
    for i in gone - exact:  # by edits: most words of an item are there
        assert any(len(set(x.split()) & set(plain(before[i]).split())) > 0.6 * len(set(x.split())) for x in items)


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary_path())
    tok.encode_special_tokens = True
    before, after = rows_of(stages[4][0]), stages[4][1].collect()
    sizes, fill = {}, {}
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill.get(r["sequence_id"], 0)
        fill[r["sequence_id"]] = r["offset"] + r["length"]
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert max(fill.values()) <= 2048
    assert sizes == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in before.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_its_whole_table(spark, name):
    out = QUERIES[name](spark, SF)
    kinds = {"op4": ("pages", "page_id"), "op5": ("pages", "page_id"), "op11": ("conversations", "conv_id"), "op13": ("embeddings", "vec_id")}
    kind, key = kinds.get(name.split("_")[0], ("documents", "doc_id"))
    n = table(spark, SF, kind).select(key).distinct().count()
    if name.startswith("op7"):
        assert out.columns == ["doc_id", "item_id", "distance", "start", "end"] and out.count() > 0
    else:
        assert out.select(key).distinct().count() == n


CLASHING = "doc_id long, text string, n_chars long, kept boolean, n_removed int, carry string, _own int, _kept_id string, chunk int, component_id long"


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, rows without an id, clashing columns."""
    import random

    rnd = random.Random(4)
    text = lambda n: " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))
    one, two, shared = text(120), text(200), text(30)
    texts = [(1, one), (1, one), (2, one + " more"), (3, two + " " + shared), (4, text(90) + " " + shared), (5, None), (6, ""), (None, one + " again"), (None, text(80)), (None, None), (7, text(60_000)), (7, text(70))]
    return spark.createDataFrame([(i, t, None if t is None else len(t), True, k, "c", k, "x", k % 3, None) for k, (i, t) in enumerate(texts)], CLASHING)


def test_stages_on_odd_rows_and_empty_tables(spark, monkeypatch):
    docs = odd_docs(spark)
    kept = corpus_pipeline.jaccard_join(spark, docs, SF)
    assert kept.columns == docs.columns
    found = sorted(((r["doc_id"], (r["text"] or "")[:20]) for r in kept.collect()), key=str)
    want = {(r["doc_id"], (r["text"] or "")[:20]) for r in docs.collect() if r["doc_id"] != 2 and not (r["doc_id"] is None and (r["text"] or "").endswith("again"))}
    assert found == sorted(want, key=str)  # a copy without an id goes too, repeated rows stay once
    out = corpus_pipeline.substring_dedup(spark, docs, SF)
    assert out.columns == docs.columns and out.count() == docs.count()
    by = {(r["doc_id"], r["_own"]): r for r in out.collect()}
    assert by[4, 4]["n_chars"] == len(by[4, 4]["text"]) < len(docs.filter("_own = 4").first()["text"]) and by[3, 3]["text"] == docs.filter("_own = 3").first()["text"]
    assert by[5, 5]["text"] is None and by[6, 6]["text"] == ""
    for before in (docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")), docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).filter("false")):
        for name, stage in corpus_pipeline.STAGES:
            after = written(stage(spark, before, SF), name)
            if name != "packing":
                assert after.columns == before.columns
            else:
                assert after.filter("doc_id is not null").select("doc_id").distinct().count() == before.filter("doc_id is not null").select("doc_id").distinct().count()
            before = after


def test_many_rows_of_one_id_are_spread_over_chunks(spark, monkeypatch):
    """A third of all rows without an id: no chunk holds them all, and results stay the same."""
    from slopeline.llm import jaccard, repeats

    rows = [(k if k % 3 else None, " ".join(f"v{(k * 7 + j * j) % 501}" for j in range(60))) for k in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, repeats.remove_repeats(df).select("carry.doc_id", "n_words", "n_removed", "kept").collect()), key=str)
    sets = sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str)
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 2000)
    assert sorted(map(tuple, repeats.remove_repeats(df).select("carry.doc_id", "n_words", "n_removed", "kept").collect()), key=str) == whole
    assert sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str) == sets
