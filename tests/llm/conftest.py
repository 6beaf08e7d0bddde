import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from trackspark.session import build_session


@pytest.fixture(scope="session")
def spark():
    yield build_session("llm-tests", "8", 4)


@pytest.fixture
def notes(spark):
    """Notes from a list of texts, ids from 1, with columns whose names clash with the operators' own."""
    def make(texts, first=1):
        rows = [(first + i, t, "x", None, 7) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, "id long, text string, score string, carry string, n long")
    return make
