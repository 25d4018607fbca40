"""Every query with SQL gives DuckDB's rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from compare import SF, connection, of_duck, of_spark

from quillspark.plans import suite


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(suite.oracle_sql()))
def test_against_duckdb(spark, duck, name):
    assert of_spark(suite.queries()[name](spark, SF)) == of_duck(duck, suite.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
