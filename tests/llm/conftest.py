import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from conftest_llm import CLASHING, SCHEMA, documents


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide(docs):
    """With columns whose names clash with those of results."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("theirs") for c in CLASHING})


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(k, k % 2, int(k % 4 == 1)) for k in range(34)] + [(3, 0, 0), (None, 1, 1), (9, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
