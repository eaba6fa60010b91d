"""The registered queries of this subpackage, and DuckDB text where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .alignment import align_tokens
from .archives import archive_round_trip
from .conversations import damaged, repair_report
from .jaccard import jaccard_components
from .lattice import lattice_scores
from .leaks import benchmark_hits
from .packing import pack_documents
from .quality import quality_verdicts
from .repeats import remove_repeats
from .shared import table
from .templates import main_text
from .tokenfile import read_tokens, token_folder, write_tokens
from .tokens import vocabulary_path
from .toxicity import fit_chain, score_toxicity
from .vectors import near_vectors


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents"))


def op2_substring_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), size=13, start=7)
    return out.select(F.col("carry.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.tiktoken"))


def op4_template_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op5_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = archive_round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "archives"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_chain(docs, table(spark, sf_dir, "labels")))


def op7_pigeonhole_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_folder(spark)
    manifest = write_tokens(table(spark, sf_dir, "documents"), folder, vocabulary_path())
    return read_tokens(manifest, folder)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, t=90)


def op11_path_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damaged(table(spark, sf_dir, "conversations")), "present")


def op12_tokenizer_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_tokens(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return out.withColumn("groups_sha256", digest).drop("groups")


def op13_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


QUERIES = {
    "op1_quality_mcd": op1_quality_mcd,
    "op2_substring_doubling": op2_substring_doubling,
    "op3_subword_lattice": op3_subword_lattice,
    "op4_template_classes": op4_template_classes,
    "op5_arc_to_warc": op5_arc_to_warc,
    "op6_toxicity_chain": op6_toxicity_chain,
    "op7_pigeonhole_leaks": op7_pigeonhole_leaks,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_token_files": op9_token_files,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_path_ranking": op11_path_ranking,
    "op12_tokenizer_spans": op12_tokenizer_spans,
    "op13_multi_index": op13_multi_index,
}

#: The word pattern and the ASCII letters of the contracts.
WORDS = r"'[^\x20\x09-\x0D]+'"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

def repair_sql() -> str:
    """DuckDB text of op11: crc32 by its rule, then a step a turn that keeps the least (cost, audit,
    repaired lines) of each state; of equal costs the least audit so far stays the least to the end."""
    far = 1 << 40

    def edit(state: str, letter: str, cost: str, line: str = "") -> str:
        lines = f"list_append({state}.t, {line})" if line else f"{state}.t"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {lines}}}"

    def best(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    def keep(state: str, initial: str) -> str:
        return edit(state, "K", f"CASE WHEN n.role[1:1] = '{initial}' THEN n.stays ELSE {far} END", "n.role || ':' || n.text")

    def rerole(state: str, role: str) -> str:
        return edit(state, "R", "1 + n.stays", f"'{role}:' || n.text")

    def insert(state: str, role: str) -> str:
        return edit(state, "I", "5", f"'{role}:'")

    drop = {k: edit(f"p.s{k}", "D", "2") for k in range(4)}
    two = best(drop[2], *(keep(f"p.s{k}", "u") for k in (0, 1, 3)), *(rerole(f"p.s{k}", "user") for k in (0, 1, 3)))
    three = best(drop[3], keep("p.s2", "a"), rerole("p.s2", "assistant"))
    start, never = "{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}", f"{{'c': {far}::BIGINT, 'a': '', 't': []::VARCHAR[]}}"
    return f"""
WITH RECURSIVE tab AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([i::BIGINT], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS x FROM range(256) r(i)) e),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: unicode(ch)::BIGINT)),
    lambda x, b: xor(x >> 8, tab.t[(xor(x, b) & 255) + 1]))) % 20 AS k FROM conversations, tab),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM src WHERE k <> 0),
seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM dam),
flt AS MATERIALIZED (SELECT conv_id, turn, role, text, i, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS f, lead(role) OVER (PARTITION BY conv_id ORDER BY i) AS role2 FROM seq),
num AS MATERIALIZED (SELECT conv_id, i, role, text, CASE f WHEN 't' THEN 5 WHEN '' THEN 0 ELSE {far} END AS stays FROM flt),
walk AS (SELECT conv_id, 0::BIGINT AS i, {start} AS s0, {never} AS s1, {insert(start, "user")} AS s2, {insert(insert(start, "user"), "assistant")} AS s3 FROM (SELECT DISTINCT conv_id FROM seq) u
  UNION ALL SELECT q.conv_id, q.i, q.s0, q.s1, q.s2, {best("q.b3", insert("q.s2", "assistant"))} FROM (
    SELECT o.conv_id, o.i, o.s0, o.s1, {best("o.b2", insert("o.s0", "user"), insert("o.s1", "user"), insert("o.b3", "user"))} AS s2, o.b3 FROM (
      SELECT p.conv_id, n.i, {drop[0]} AS s0, {best(drop[1], keep("p.s0", "s"))} AS s1, {two} AS b2, {three} AS b3
      FROM walk p JOIN num n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.i = p.i + 1) o) q),
fin AS (SELECT w.conv_id, {best("w.s0", "w.s3")} AS b FROM walk w JOIN (SELECT conv_id, max(i) AS i FROM seq GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated,
  count(*) FILTER (role2 IS NOT NULL AND role[1:1] || role2[1:1] NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(cnt.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(cnt.blank, 0) AS BIGINT) AS blank, CAST(coalesce(cnt.duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(cnt.truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(cnt.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(fin.b.c, 0) AS BIGINT) AS cost, coalesce(fin.b.a, '') AS audit,
  sha256(coalesce(array_to_string(fin.b.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fin ON fin.conv_id IS NOT DISTINCT FROM c.conv_id"""


#: The other queries have no SQL form (estimates, scores, markup, tokens, edit distances).
ORACLE: dict[str, str] = {
    "op2_substring_doubling": f"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d WHERE len(w) >= 13),
win AS MATERIALIZED (SELECT doc_id, k, md5(array_to_string(w[k:k + 12], ' ')) AS s FROM p),
bad AS (SELECT win.doc_id, win.k FROM win JOIN (SELECT s, min(doc_id) AS first FROM win GROUP BY s) f ON win.s = f.s WHERE f.first < win.doc_id),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, i FROM (SELECT doc_id, unnest(range(k, k + 13)) AS i FROM bad) g),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT word.doc_id, string_agg(word.x, ' ' ORDER BY word.i) AS t, count(*) AS n FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i WHERE gone.i IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id""",
    "op5_arc_to_warc": """
WITH d AS MATERIALIZED (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
k AS (SELECT digest, n, max(page_id) AS top FROM d GROUP BY digest, n)
SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest, CASE WHEN d.n >= 1000 AND d.page_id <> k.top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN d.n >= 1000 AND d.page_id <> k.top THEN k.top END AS refers_to FROM d JOIN k ON d.digest = k.digest AND d.n = k.n""",
    "op10_jaccard_join": f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), {WORDS}) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS k FROM d WHERE len(w) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, md5(array_to_string(w[k:k + 2], ' ')) AS g FROM p),
size AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
link AS MATERIALIZED (SELECT a, b FROM common JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 100 * i >= 90 * (sa.n + sb.n - i)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(least.m, d.doc_id)) AS component_id
FROM d LEFT JOIN size ON d.doc_id = size.doc_id LEFT JOIN least ON d.doc_id = least.a""",
    "op11_path_ranking": repair_sql(),
    "op13_multi_index": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS MATERIALIZED (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(least.m, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(least.m, v.vec_id)) AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN least ON v.vec_id = least.a""",
}
