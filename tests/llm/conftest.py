import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import awkward_tables  # noqa: E402


@pytest.fixture
def docs(spark, tmp_path):
    return lambda rows: awkward_tables.table(spark, rows, tmp_path)
