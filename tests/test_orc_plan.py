"""Rows and deleted keys of a table stay on the executors, however small their files are."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.table import log
from rillstone.table.log import Table

SCHEMA = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("data", T.StringType())])


def table(spark, root):
    t = Table.create(spark, root, SCHEMA, ["id"], None, {"write.format.default": "orc"})
    o = spark.range(20_000).withColumn("data", F.lit("x"))
    t.append(o)
    third = o.filter("id % 3 = 0")
    t.row_delta(third.filter("id % 6 = 0").withColumn("data", F.lit("y")), third.select("id"), None)
    return t


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_rows_are_never_the_side_that_is_broadcast(spark, tmp_path, rows, monkeypatch):
    t = table(spark, f"file://{tmp_path}/t")
    want = sorted((i, "y" if i % 6 == 0 else "x") for i in range(20_000) if i % 3 or i % 6 == 0)
    for listed in (True, False):  # the list of files broadcast or not
        if not listed:
            monkeypatch.setattr(log, "LISTED", 0)
        df = t.read()
        assert "BuildLeft" not in plan(df)
        assert sorted(tuple(r) for r in df.collect()) == want


def test_many_deleted_keys_are_not_broadcast(spark, tmp_path, monkeypatch):
    t = table(spark, f"file://{tmp_path}/t")
    assert plan(t.read()).count("BroadcastHashJoin") == 2  # the list of files and the keys
    monkeypatch.setattr(log, "KEY_BYTES", 1000)
    df = t.read()
    assert plan(df).count("BroadcastHashJoin") == 1 and "SortMergeJoin" in plan(df)
    assert df.count() == 16_667
