"""LIBSVM text (``label idx:value ...``) through Spark's built-in ``libsvm`` data source.

On read, vectors become ``ARRAY<DOUBLE>`` or, with ``sparse=True``, the two arrays that a
sparse vector holds, as a struct ``features(indices, values)`` -- never filled up with zeros.
On write, arrays become vectors. All are JVM-side column functions.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_libsvm(spark: SparkSession, path: str, num_features: int | None = None, *, with_key: bool = False,
                partitions: int | None = None, sparse: bool = False) -> DataFrame:
    """``label DOUBLE, features`` rows of a LIBSVM file or folder.

    Give ``num_features`` so the scan does not need an extra pass to find the width.
    ``with_key`` adds a ``key``, a hash of the row's content (the same under any layout).
    ``partitions`` re-partitions the rows after the scan.
    """
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", str(int(num_features)))
    feats = sparse_features("features") if sparse else vector_to_array("features", "float64")
    df = reader.load(path).select(F.col("label").cast("double").alias("label"), feats.alias("features"))
    if with_key:
        df = df.withColumn("key", F.xxhash64("label", "features"))
    if partitions:
        df = df.repartition(int(partitions))
    return df


def sparse_features(vector: str | Column) -> Column:
    """A Spark ML vector column as ``struct<indices, values>`` without filling in zeros (a dense
    vector gives all its entries)."""
    v = F.unwrap_udt(F.col(vector) if isinstance(vector, str) else vector)
    dense = F.transform(v["values"], lambda x, k: k)
    return F.when(v.isNotNull(), F.struct(F.coalesce(v["indices"], dense).alias("indices"), v["values"].alias("values")))


def entries_of(df: DataFrame, *, key: str = "key", features: str = "features") -> DataFrame:
    """Sparse rows as the long form ``(key, idx, value)`` of wide mode."""
    pairs = F.arrays_zip(F.col(features)["indices"], F.col(features)["values"])
    return df.select(F.col(key).alias("key"), F.explode(pairs).alias("p")).select(
        "key", F.col("p.indices").alias("idx"), F.col("p.values").alias("value"))


def write_libsvm(df: DataFrame, path: str, *, label: str = "label", features: str = "features",
                 mode: str = "error") -> str:
    """Write ``label`` and an array ``features`` column as LIBSVM text (zeros are omitted)."""
    out = df.select(F.col(label).cast("double").alias("label"),
                    array_to_vector(F.col(features).cast("array<double>")).alias("features"))
    out.write.mode(mode).format("libsvm").save(path)
    return path
