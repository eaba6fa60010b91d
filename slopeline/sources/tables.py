"""Training tables built from the parquet tables of a data folder.

Every builder returns ``key BIGINT, label DOUBLE, features ARRAY<...>`` (dense form) or the
long form ``key, idx, value`` plus ``key, label``. Only the columns a builder needs are
read, so the parquet scan prunes everything else. Features are kept in their stored
precision (``embedding`` is FLOAT) and widened to DOUBLE where arithmetic happens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Fixed values of the fixtures: FX1 positives are embedding labels below 5; FX2 scales
# lineitem columns by 50, 105000, 10 and 12.5; FX4 scales by 50, 1000 and 105000; FX5 scales
# characters by 10000 and words by 2000.
FX1_POSITIVE_BELOW = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def embeddings_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX1: ``embeddings`` with label ``label < 5`` and 64 float features."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("key"),
        F.when(F.col("label") < FX1_POSITIVE_BELOW, 1.0).otherwise(0.0).alias("label"),
        F.col("embedding").alias("features"),
    )


def lineitem_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX2: ``lineitem`` rows, label ``l_returnflag = 'R'``, 5 scaled features."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("key"),
        F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("label"),
        F.array(
            F.lit(1.0),
            F.col("l_quantity") / 50.0,
            F.col("l_extendedprice") / 105000.0,
            F.col("l_discount") * 10.0,
            F.col("l_tax") * 12.5,
        ).alias("features"),
    )


def embeddings_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX3: ``embeddings`` with the 10-class label as double."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("key"), F.col("label").cast("double").alias("label"),
                    F.col("embedding").alias("features"))


def lineitem_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX4: ``lineitem`` joined to ``part``; least-squares target is the scaled price.

    ``part`` is the dimension side; Catalyst picks the join strategy from the statistics
    (broadcast while ``part`` is below the broadcast threshold, sort-merge beyond it).
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    return j.select(
        F.col("l_orderkey").alias("key"),
        (F.col("l_extendedprice") / 105000.0).alias("label"),
        F.array(F.lit(1.0), F.col("l_quantity") / 50.0, F.col("p_retailprice") / 1000.0).alias("features"),
    )


def documents_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FX5: ``labels`` joined to ``documents``; label ``quality``; length features.

    The word count is the number of space-separated parts of the whole text. It is computed
    on the documents side before the join, so only ``(doc_id, n_chars, words)`` -- never the
    texts -- can cross a shuffle if the join is not broadcast.
    """
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", F.size(F.split(F.col("text"), " ", -1)).alias("words"))
    j = lab.join(docs, "doc_id", "inner")
    return j.select(
        F.col("doc_id").alias("key"),
        F.col("quality").cast("double").alias("label"),
        F.array(F.lit(1.0), F.col("n_chars") / 10000.0, F.col("words") / 2000.0).alias("features"),
    )


def embeddings_long(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """FX6: FX1 in long form ``(key, idx, value)`` without entries that are exactly zero,
    plus the ``(key, label)`` table."""
    fx1 = embeddings_binary(spark, sf_dir)
    entries = (fx1.select("key", F.posexplode("features").alias("idx", "value"))
               .select("key", F.col("idx").cast("int").alias("idx"), F.col("value").cast("double").alias("value"))
               .where(F.col("value") != F.lit(0.0)))
    return entries, fx1.select("key", "label")


FIXTURES = {
    "fx1": embeddings_binary,
    "fx2": lineitem_returns,
    "fx3": embeddings_multiclass,
    "fx4": lineitem_prices,
    "fx5": documents_quality,
}
