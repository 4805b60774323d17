import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from fixtures import documents  # noqa: E402

@pytest.fixture(scope="session")
def llm_spark(spark):
    """The session with few partitions, as tables are tiny here."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.fixture(scope="session")
def doc_rows():
    return documents()


@pytest.fixture(scope="session")
def docs(llm_spark, doc_rows):
    """The rows with extra columns whose names occur inside the operators, and a row without an id."""
    rows = [(i, t, 1, "x", None) for i, t in doc_rows] + [(None, "row without an id " * 3, 2, "y", 0.5)]
    return llm_spark.createDataFrame(rows, "doc_id long, text string, n long, h1 string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("false")
