"""The consistent tables against SQL that knows the columns of the test tables."""

import pytest

from rillstone.plans import pipeline
from tests.fixtures import DATA, connect, spark_rows, sql_rows


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(pipeline.DRIFTED_ORACLE))
def test_consistent_table(spark, name):
    assert spark_rows(pipeline.QUERIES[name](spark, str(DATA))) == sql_rows(connect(DATA), pipeline.DRIFTED_ORACLE[name])
