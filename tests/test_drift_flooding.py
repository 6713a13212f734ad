"""Similarity flooding decides what goes on as what."""

import pytest

from rillstone.operators import drift
from rillstone.plans import pipeline
from tests.fixtures import DATA
from tests.test_drift import build


def found(spark, files):
    feed, meta = build(spark, files)
    return sorted(tuple(r)[1:] for r in drift.changes_table(spark, feed, meta, ["id"]).collect())


def twins(old, new):
    """Two objects, in each of which a field of the same values is renamed."""
    return [(1, [(i, {"p": {"id": i, old: f"v{i}"}, "q": {"flag": True, "size": 1.5, old: f"v{i}"}}) for i in range(12)]), (2, [(i, {"p": {"id": i, new: f"v{i}"}, "q": {"flag": True, "size": 1.5, new: f"v{i}"}}) for i in range(12)])]


def test_only_the_graph_tells_equally_likely_renames_apart(spark, monkeypatch):
    assert found(spark, twins("was", "is")) == [(2, "renamed", "p.was", "p.is"), (2, "renamed", "q.was", "q.is")]
    # without what flows in, both pairings score alike
    s, n = ({"p.id": "integer", "p.was": "string", "q.flag": "boolean", "q.was": "string"}, {"p.id": "integer", "p.is": "string", "q.flag": "boolean", "q.is": "string"})
    alike = {(a, b): 0.9 for a in ("p.was", "q.was") for b in ("p.is", "q.is")}
    flooded = drift.flood(s, n, alike)
    assert flooded["p.was", "p.is"] > flooded["p.was", "q.is"] and flooded["q.was", "q.is"] > flooded["q.was", "p.is"]
    monkeypatch.setattr(drift, "DAMPING", 0.0)
    dry = drift.flood(s, n, alike)
    assert dry["p.was", "p.is"] == pytest.approx(dry["p.was", "q.is"])


def test_a_renamed_object_takes_its_fields_along(spark):
    files = [(1, [(i, {"id": i, "home": {"street": f"s{i}", "zip": i}}) for i in range(12)]), (2, [(i, {"id": i, "house": {"street": f"s{i}", "zip": i}}) for i in range(12)])]
    assert found(spark, files) == [(2, "renamed", "home.street", "house.street"), (2, "renamed", "home.zip", "house.zip")]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_no_change_comes_about_without_the_scores(spark, monkeypatch):
    right = {tuple(r) for r in pipeline.p6_found(spark, str(DATA)).collect()}
    kept = drift.flood
    monkeypatch.setattr(drift, "flood", lambda *a: {k: 1 - v for k, v in kept(*a).items()})
    assert {tuple(r) for r in pipeline.p6_found(spark, str(DATA)).collect()} != right
    monkeypatch.setattr(drift, "flood", lambda *a: {})
    assert {r.change for r in pipeline.p6_found(spark, str(DATA)).collect()} == {"added", "removed"}


def test_files_of_one_schema_are_one_version(spark):
    files = [(i, [(i, {"id": i, "a": "x"} if i < 5 else {"id": i, "a": 5})]) for i in range(10)] + [(10, [(1, {"id": 1, "a": "y"})])]
    feed, meta = build(spark, files)
    got = drift.versions(feed, meta)
    assert [(r.file_id, r.version, r.shape is not None) for r in got.orderBy("place").collect()] == [(i, 1 if i < 5 else 2 if i < 10 else 3, i in (0, 5, 10)) for i in range(11)]
    assert [(f, s["a"]) for f, _, s in drift.schemas(got)["t"]] == [(0, "string"), (5, "integer"), (10, "string")]


def test_texts_that_are_no_objects_are_counted(spark, rows):
    feed, _ = build(spark, [(1, [(1, {"id": 1}), (2, "no json"), (3, "[1]"), (4, None)]), (2, [(1, {"id": 2})])])
    assert rows(drift.unreadable_texts(feed)) == [("t", 1, 2)]
