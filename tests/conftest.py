from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weekgrid.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "weekgrid-tests")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a column expression over one row of named values."""

    def run(column, **values):
        names = list(values) or ["_none"]
        row = spark.createDataFrame([tuple(values.values()) or (0,)], names)
        return row.select(column.alias("v")).first().v

    return run
