import pytest
from samples import ROWS


@pytest.fixture(scope="session")
def rows():
    return [(d, t) for d, t, _ in ROWS]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, ties, a repeated row, and columns whose names operators use themselves."""
    data = [(d, t, s, 1, "c", 0.5) for d, t, s in ROWS]
    return spark.createDataFrame(data, "doc_id long, text string, source string, length int, label string, score double").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
