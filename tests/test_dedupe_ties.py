"""One row per identifier also where the number that decides ties is null or repeated."""

import pytest

from rillstone.operators import dedupe

SCHEMA = "a string, b bigint, t bigint, id bigint, extra string"
ROWS = [
    ("once", 1, 5, None, "p"),
    ("late", 1, 5, None, "p"), ("late", 1, 5, 7, "q"), ("late", 1, None, 1, "r"),
    ("nulls", 1, 5, None, "p"), ("nulls", 1, 5, None, "p"), ("nulls", 1, 6, None, "p"),
    ("again", None, 5, 9, "p"), ("again", None, 5, 9, "p"), ("again", None, 6, 10, "q"),
    ("other", 2, 5, 9, "s"),
]


@pytest.mark.parametrize("group_rows", [1_000_000, 1])
def test_null_and_repeated_ties(spark, rows, group_rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    want = [("again", None, 5, 9, "p"), ("late", 1, 5, 7, "q"), ("nulls", 1, 5, None, "p"), ("once", 1, 5, None, "p"), ("other", 2, 5, 9, "s")]
    assert rows(dedupe.deduplicate(df, None, ["a", "b"], "t", "id", group_rows=group_rows)) == sorted(want, key=repr)
    assert rows(dedupe.deduplicate(df.limit(4), df.filter("a <> 'late' and a <> 'once'"), ["a", "b"], "t", "id", group_rows=group_rows)) == sorted(want, key=repr)
