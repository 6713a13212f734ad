"""No file and no object is left out: files that the list of files lacks, and integers of any length."""

import pytest

from rillstone.operators import drift
from tests.test_drift import build

LONG = "7" * 5000


def named(field):
    return [(i, {"id": i, field: f"v{i}"}) for i in range(12)]


@pytest.mark.parametrize(
    "listed, want",
    [
        ("file_id < 3", [(1, "renamed", "b", "a"), (3, "renamed", "a", "c")]),
        ("file_id = 2", [(1, "renamed", "b", "a"), (3, "renamed", "a", "c")]),
        ("file_id = 3", [(1, "renamed", "c", "a"), (2, "renamed", "a", "b")]),
        ("false", [(2, "renamed", "a", "b"), (3, "renamed", "b", "c")]),
    ],
)
def test_files_not_listed_come_last(spark, listed, want):
    feed, meta = build(spark, [(2, named("b")), (1, named("a")), (3, named("c"))])
    assert sorted(tuple(r)[1:] for r in drift.changes_table(spark, feed, meta.filter(listed), ["id"]).collect()) == want


def test_values_of_files_not_listed_are_in_the_table(spark):
    feed, meta = build(spark, [(1, named("was")), (2, named("is"))])
    got = drift.consistent_table(spark, feed, meta.filter("file_id = 1"), "t", ["id"])
    assert got.columns == ["delivery_id", "file_id", "id", "was"] and got.filter("was = concat('v', id)").count() == 24


def test_objects_with_long_integers_are_read(spark, rows):
    files = [(1, [(1, {"id": 1})]), (2, [(1, f'{{"id": 1, "x": "a", "big": {LONG}}}')]), (3, [(1, f'{{"id": 1, "x": "a", "large": {LONG}}}')])]
    feed, meta = build(spark, files)
    got = sorted(tuple(r)[1:] for r in drift.changes_table(spark, feed, meta, ["id"]).collect())
    assert got == [(2, "added", "big", "big"), (2, "added", "x", "x"), (3, "renamed", "big", "large")]
    assert drift.unreadable_texts(feed).count() == 0
    assert [r.x for r in drift.consistent_table(spark, feed, meta, "t", ["id"]).orderBy("delivery_id").collect()] == [None, "a", "a"]


def test_long_integers_in_a_column_of_numbers_are_infinite_as_in_sql(spark, rows):
    feed, meta = build(spark, [(1, [(1, {"id": 1, "n": 0.5})]), (2, [(1, f'{{"id": 1, "n": {LONG}}}'), (2, f'{{"id": 2, "n": -{LONG}}}')])])
    assert [r.n for r in drift.consistent_table(spark, feed, meta, "t", ["id"]).orderBy("delivery_id").collect()] == [0.5, float("inf"), float("-inf")]
    assert rows(drift.unheld_integers(spark, feed, meta, "t", ["id"])) == [("n", "rounded", 2)]
