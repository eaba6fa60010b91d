"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
reread as the docs of the next stage; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeline.llm.jaccard import one_of_each
from slopeline.llm.leaks import without_hits
from slopeline.llm.packing import pack_documents
from slopeline.llm.quality import keep_sound
from slopeline.llm.repeats import remove_repeats
from slopeline.llm.shared import table, written
from slopeline.llm.tokens import vocabulary_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no robust outliers. Null and empty texts fail the base
    rules and go; rows that share a doc_id stay if one of them passes."""
    return keep_sound(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the least doc_id) of each group linked by 0.8 of their five-word shingles. Repeated
    rows of one doc_id and text stay once; rows without a doc_id come after all others and are told
    apart by their text; null and empty texts are in no group and stay."""
    return one_of_each(docs, size=5, t=80)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows that an earlier document has. A changed text is its kept
    words joined by one space, and n_chars follows it; other rows stay as they are. Null texts
    stay null; rows without a doc_id count as one document after all others; columns may have any name."""
    out = remove_repeats(docs, size=13, start=7, carry=docs.columns)
    changed, own = F.col("n_removed") > 0, {c: F.col("carry")[c] for c in docs.columns}
    own["text"] = F.when(changed, F.col("kept")).otherwise(own["text"])
    if "n_chars" in own:
        own["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return out.select(*(column.alias(c) for c, column in own.items()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs within its edit budget. Null and empty texts hold none."""
    return without_hits(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most 2048 tokens. A null or empty text
    is its end id alone; repeated rows are packed each."""
    return pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The estimates, the components and the tokens have no SQL form; tests/llm checks the pipeline
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
