import json
from datetime import datetime, timedelta

from rillstone.operators import drift

FEED = "delivery_id bigint, topic string, file_id bigint, record_key string, after string, kind string"


def build(spark, files):
    rows, meta, n = [], [], 0
    for i, (fid, objects) in enumerate(files):
        meta.append(("t", fid, datetime(2025, 1, 1) + timedelta(days=i)))
        for k, o in objects:
            n += 1
            rows.append((n, "t", fid, json.dumps({"id": k}), o if isinstance(o, str) or o is None else json.dumps(o), "x"))
    return spark.createDataFrame(rows, FEED), spark.createDataFrame(meta, "topic string, file_id bigint, opened_at timestamp_ntz")


def test_every_kind_of_change(spark):
    names = [f"name{i}" for i in range(20)]
    files = [
        (9, [(i, {"id": i, "nick": names[i], "n": i, "o": {"p": 1, "q": None}, "flag": True}) for i in range(20)]),
        (3, [(i, {"id": i, "alias": names[i], "n": float(i), "o": {"p": 1, "q": [1]}, "b": False}) for i in range(20)]),
        (7, [(i, {"id": str(i), "alias": names[i], "n": 1.5, "o": None, "b": None}) for i in range(20)] + [(1, None), (2, "no json"), (3, "[1]")]),
        (5, [(i, {"id": str(i), "alias": names[i], "n": 1.5, "o": {"p": 2, "q": []}, "b": True}) for i in range(20)]),
    ]
    feed, meta = build(spark, files)
    got = sorted(tuple(r)[1:] for r in drift.changes_table(spark, feed, meta, ["id"]).collect())
    assert got == sorted(
        [
            (3, "renamed", "nick", "alias"), (3, "retyped", "n", "n"), (3, "removed", "flag", "flag"), (3, "added", "b", "b"),
            (7, "retyped", "id", "id"), (7, "removed", "o.p", "o.p"), (7, "removed", "o.q", "o.q"),
            (5, "added", "o.p", "o.p"), (5, "added", "o.q", "o.q"),
        ]
        + [(3, "retyped", "o.q", "o.q")] * 0
    )


def test_two_flags_are_no_rename_by_chance(spark):
    files = [(1, [(i, {"id": i, "was": i % 2 == 0}) for i in range(40)]), (2, [(i, {"id": i, "now": i % 3 == 0}) for i in range(40)])]
    feed, meta = build(spark, files)
    assert sorted(r.change for r in drift.changes_table(spark, feed, meta, ["id"]).collect()) == ["added", "removed"]


def test_one_table_in_types_that_hold_all(spark):
    files = [(1, [(i, {"id": i, "nick": f"v{i}", "n": i, "t": 5}) for i in range(12)]), (2, [(i, {"id": i, "alias": f"v{i}", "n": i + 0.5, "t": "x"}) for i in range(12)]), (3, [(1, {"id": 2**70, "alias": "z", "n": None, "t": [1, "é"]})])]
    feed, meta = build(spark, files)
    t = drift.consistent_table(spark, feed, meta, "t", ["id"])
    assert dict(t.dtypes) == {"delivery_id": "bigint", "file_id": "bigint", "id": "bigint", "n": "double", "nick": "string", "t": "string"}
    rows = {r.delivery_id: r for r in t.collect()}
    assert rows[1].nick == "v0" and rows[13].nick == "v0" and rows[13].n == 0.5 and rows[2].t == "5" and rows[25].t == '[1, "é"]' and rows[25].id is None


def test_nothing(spark):
    feed, meta = build(spark, [(1, [(1, None)])])
    assert drift.changes_table(spark, feed, meta, ["id"]).count() == 0
    assert drift.changes_table(spark, feed.filter("false"), meta.filter("false"), ["id"]).count() == 0
    assert drift.consistent_table(spark, feed, meta, "t", ["id"]).columns == ["delivery_id", "file_id"]


def test_flooding_prefers_names_and_structure():
    old, new = {"a.street": "string", "a.city": "string", "x": "string"}, {"a.road": "string", "a.city": "string", "y": "string"}
    score = drift.flood(old, new, {})
    assert score["a.city", "a.city"] == max(score.values()) and score["a.street", "a.road"] > score["a.street", "y"]
    assert max(score.values()) <= 1.0
