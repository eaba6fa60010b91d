import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.driver.memory", "8g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="slopeline-test-ckpt-"))
    yield s


@pytest.fixture(scope="session")
def fx1(spark):
    from slopeline.sources import tables

    return tables.embeddings_binary(spark, SF_CHECK).cache()


@pytest.fixture(scope="session")
def fx1_np(fx1):
    import numpy as np

    pdf = fx1.orderBy("key").toPandas()
    x = np.vstack(pdf.features.to_numpy()).astype(np.float64)
    return pdf.key.to_numpy(), x, pdf.label.to_numpy().astype(np.float64)
