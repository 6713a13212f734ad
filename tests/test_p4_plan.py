"""The query that finds the current actors merges them column by column."""

import pytest

from rillstone.operators import lww
from rillstone.plans import pipeline
from tests.fixtures import DATA


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_the_plan_keeps_every_field(spark):
    plan = pipeline.p4_found(spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    for f in pipeline.ACTOR_FIELDS:
        assert f"_f_{f}" in plan
    assert plan.count("max_by(") >= len(pipeline.ACTOR_FIELDS) and "from_json" in plan


def test_each_field_has_the_position_that_set_it(spark, rows):
    df = spark.createDataFrame([(1, 1, "c", "a", 1), (1, 2, "u", "b", None), (1, 3, "u", None, 7), (2, 1, "c", "z", 2), (2, 4, "d", None, None)], "k bigint, seq bigint, op string, x string, y bigint")
    got = lww.apply_changes(df, ["k"], "seq", "op", {"x": ("x", "x is not null"), "y": ("y", "y is not null")}, replace_ops=["c"], patch_ops=["u"], delete_ops=["d"], positions=True)
    assert rows(got.select("k", "last_change", "x", "x_at", "y", "y_at")) == [(1, 3, "b", 2, 7, 3)]
