import pytest

from rillstone.llm import queries
from tests.fixtures import DATA, connect, spark_rows, sql_rows, variant

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    root = tmp_path_factory.mktemp("variants")
    return {"small": str(DATA), **{kind: variant(root / kind, kind) for kind in ("empty", "nulls", "all-nulls")}}


@pytest.mark.parametrize("kind", ["small", "empty", "nulls", "all-nulls"])
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folders, name, kind):
    cols, got = spark_rows(queries.QUERIES[name](spark, folders[kind]))
    if name in queries.ORACLE and kind != "all-nulls":
        assert (cols, got) == sql_rows(connect(folders[kind]), queries.ORACLE[name])


def test_every_text_is_encoded(spark):
    got = {r.doc_id: r.ids for r in queries.p8_ids(spark, str(DATA)).collect()}
    from rillstone.llm.encode import Encoder

    e = Encoder()
    for doc, text in connect(DATA).sql("select doc_id, text from documents").fetchall():
        assert e.decode(got.pop(doc)) == (text or "")
    assert not got
