"""Integers that a consistent table can't hold are counted."""

from rillstone.operators import drift
from tests.test_drift import build


def test_integers_that_become_null_or_are_rounded(spark, rows):
    files = [
        (1, [(1, {"id": 1, "n": 2**53 + 1, "m": 2**53}), (2, {"id": 2**70, "n": 5, "m": 1}), (3, {"id": -(2**63), "n": 2**60, "m": 1})]),
        (2, [(4, {"id": 2**63, "n": 0.5, "m": 0.5}), (5, {"id": 2**63 - 1, "n": -(2**53) - 1, "m": True})]),
    ]
    feed, meta = build(spark, files)
    assert rows(drift.unheld_integers(spark, feed, meta, "t", ["id"])) == [("id", "null", 2), ("n", "rounded", 2)]
    held = {r.delivery_id: r for r in drift.consistent_table(spark, feed, meta, "t", ["id"]).collect()}
    assert held[2].id is None and held[4].id is None and held[3].id == -(2**63) and held[1].n != 2**53 + 1


def test_none(spark):
    feed, meta = build(spark, [(1, [(1, {"id": 1, "n": 2**53 + 1})])])
    assert drift.unheld_integers(spark, feed, meta, "t", ["id"]).count() == 0
    assert drift.unheld_integers(spark, feed, meta, "none", ["id"]).count() == 0
