import os
import sys

import pytest
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from llm_data import EXTRA  # noqa: E402


@pytest.fixture(scope="session")
def make(spark):
    """Rows of tuples and a DDL schema -> a table with clashing extra columns."""
    def build(rows, schema):
        full = T._parse_datatype_string(f"{schema}, {EXTRA}")
        return spark.createDataFrame([tuple(r) + ("x",) * 8 for r in rows], full)
    return build
