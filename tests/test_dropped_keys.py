"""Equality deletes outlive their key columns: rows that they removed stay removed, read or compacted."""

import pytest
from pyspark.sql import types as T

from rillstone.table import compact as cp
from rillstone.table.log import EQ, Table

OLD = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("data", T.StringType())])
REPLACED = T.StructType([T.StructField("id", T.StringType(), False), T.StructField("data", T.StringType())])
DROPPED = T.StructType([T.StructField("data", T.StringType())])
WIDER = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("data", T.StringType())])


@pytest.fixture
def history(spark, tmp_path):
    """Four snapshots by the old key, of which the second to the fourth delete, then one in the new schema."""

    def make(schema, key, wider=False):
        t = Table.create(spark, f"file://{tmp_path}/t", OLD, ["id"])
        frame = lambda rows: spark.createDataFrame(rows, "id int, data string").coalesce(1)
        keys = lambda ids: spark.createDataFrame([(i,) for i in ids], "id int")
        t.append(frame([(1, "one"), (2, "two"), (3, "three"), (4, "four")]))
        t.row_delta(frame([(1, "uno"), (5, "five")]), keys([1, 2]), None)
        if wider:
            t.evolve(WIDER)
        t.row_delta(frame([(3, "tres")]), keys([3, 5]), None)
        t.row_delta(None, keys([1]), None)
        t.evolve(schema, [key])
        row = {"id": "6", "data": "six"}
        t.append(spark.createDataFrame([tuple(row[c] for c in schema.names)], ", ".join(f"{c} string" for c in schema.names)))
        return t

    return make


def texts(df):
    return sorted(r.data for r in df.collect())


@pytest.mark.parametrize("wider", [False, True])
@pytest.mark.parametrize("schema, key", [(REPLACED, "id"), (DROPPED, "data")])
def test_read_after_the_key_is_gone(history, schema, key, wider):
    t = history(schema, key, wider)
    assert texts(t.read(4)) == ["four", "tres"]
    assert texts(t.read()) == ["four", "six", "tres"] and t.read().columns == sorted(schema.names, key=t.read().columns.index)


@pytest.mark.parametrize("wider", [False, True])
@pytest.mark.parametrize("low", [None, 1, 2])
@pytest.mark.parametrize("schema, key", [(REPLACED, "id"), (DROPPED, "data")])
def test_compact_after_the_key_is_gone(spark, history, schema, key, low, wider):
    t = history(schema, key, wider)
    made = cp.compact(t, low, 5)
    assert texts(t.read()) == ["four", "six", "tres"]
    kept = [f.path for f in made.added if f.content == EQ]
    want = {None: [], 1: [1, 2, 3, 5], 2: [1, 3, 5]}[low]
    assert (sorted(r[0] for r in spark.read.parquet(*kept).collect()) if kept else []) == want
    if low is not None:
        cp.compact(t, None, made.id)
        assert texts(t.read()) == ["four", "six", "tres"]
