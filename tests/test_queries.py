"""Every query against its SQL on the smallest tables, and the pipeline's also on hard variants of them."""

import pytest

from rillstone.plans import catalogue, pipeline
from tests.fixtures import DATA, connect, spark_rows, sql_rows, variant

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")
ALL = {**pipeline.QUERIES, **catalogue.QUERIES}
SQL = {**pipeline.ORACLE, **catalogue.ORACLE}


def check(spark, name, folder):
    cols, got = spark_rows(ALL[name](spark, str(folder)))
    if name in SQL:
        ocols, want = sql_rows(connect(folder), SQL[name])
        assert cols == ocols
        assert got == want
    return got


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, name):
    check(spark, name, DATA)


@pytest.fixture(scope="module")
def variants(tmp_path_factory):
    root = tmp_path_factory.mktemp("variants")
    return {kind: variant(root / kind, kind) for kind in ("empty", "nulls", "all-nulls")}


@pytest.mark.parametrize("kind", ["empty", "nulls"])
@pytest.mark.parametrize("name", sorted(pipeline.QUERIES))
def test_pipeline_query_on_hard_tables(spark, variants, name, kind):
    got = check(spark, name, variants[kind])
    assert max(got.values(), default=1) == 1 or not name.endswith("_found")


@pytest.mark.parametrize("name", sorted(pipeline.QUERIES))
def test_pipeline_query_with_nulls_in_unique_columns(spark, variants, name):
    ALL[name](spark, variants["all-nulls"]).collect()


def test_queries_and_sql_have_one_name_each():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(ALL) <= set(e.queries())


def test_flagship(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
