import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_corpus import corpus  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, chunk string, id string, bucket int"


@pytest.fixture(scope="session")
def docs(spark):
    """The corpus with extra columns whose names the operators use themselves."""
    rows = [(i, t, "en", "s", "x", "y", 7) for i, t in corpus()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf_small():
    return "/root/testdata/sf0.001"
