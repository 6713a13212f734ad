"""Runs that follow one another over one ledger: only what is new is read, whatever is delivered again."""

import threading
import time
from datetime import datetime, timedelta

import pytest

from rillstone.operators import ledger as lg
from rillstone.operators.ledger import DONE, Ledger, Source, process, run_windows

RESULT = "run_id bigint, table_name string, row_id bigint"
START = datetime(1970, 1, 1)


def source(spark, path, data, kind="timestamp_ntz"):
    df = spark.createDataFrame([(k, None if t is None else START + timedelta(seconds=t), i) for k, t, i in data], f"k string, at {kind}, id bigint")
    df.write.mode("overwrite").parquet(path)
    return Source(spark.read.parquet(path), ["k"], "at", "id")


DATA = [("a", 5, 1), ("a", 6, 2), (None, 7, 3), ("b", 10, 4), ("b", 11, 5), ("a", 15, 6), (None, 16, 7), ("c", 17, 8), ("c", 25, 9), ("d", 25, 10), ("d", 25, 11), ("e", None, 12), ("f", 99, 13)]
WANT = {1: [(1, "t", 1), (1, "t", 3), (1, "t", 4)], 2: [(2, "t", 8)], 3: [(3, "t", 10)]}
S = 1_000_000


@pytest.mark.parametrize("steps", [[[1, 2, 3]], [[1], [1, 2], [1, 2, 3]], [[1, 2], [1, 2, 3]]])
def test_runs_at_once_or_one_by_one_bring_the_same(spark, tmp_path, rows, steps):
    src = source(spark, f"{tmp_path}/in", DATA)
    b = Ledger(spark, f"file://{tmp_path}/book")
    for runs in steps:
        b.enqueue(run_windows([(r, r * 10 * S) for r in runs], ["t"]))
        while process(spark, b, {"t": src}, "w"):
            pass
        assert rows(b.results(spark, RESULT)) == sorted(x for r in runs for x in WANT[r])


def test_a_later_run_reads_its_window_only(spark, tmp_path):
    src = source(spark, f"{tmp_path}/in", DATA)
    b = Ledger(spark, f"file://{tmp_path}/book")
    b.enqueue(run_windows([(1, 10 * S)], ["t"]))
    process(spark, b, {"t": src}, "w")
    b.enqueue(run_windows([(1, 10 * S), (2, 20 * S)], ["t"]))
    plan = lg.first_new(b, "t", src, [i for i in b.items() if i.run_id == 2])._jdf.queryExecution().executedPlan().toString()
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "at#" in x)
    assert "GreaterThan(at," in scan and "LessThanOrEqual(at," in scan


def test_an_earlier_window_that_is_left_is_not_skipped(spark, tmp_path, rows):
    src = source(spark, f"{tmp_path}/in", DATA)
    b = Ledger(spark, f"file://{tmp_path}/book", clock := type("C", (), {"now": 0.0, "__call__": lambda s: s.now})())
    b.enqueue(run_windows([(r, r * 10 * S) for r in (1, 2, 3)], ["t"]))
    b.lease("dead", 1, 60)
    process(spark, b, {"t": src}, "w")
    assert rows(b.results(spark, RESULT)) == WANT[2] + WANT[3]
    clock.now = 61
    process(spark, b, {"t": src}, "w")
    assert rows(b.results(spark, RESULT)) == WANT[1] + WANT[2] + WANT[3]


def test_a_retry_replaces_what_a_dead_writer_left(spark, tmp_path, rows, monkeypatch):
    src = source(spark, f"{tmp_path}/in", DATA)
    b = Ledger(spark, f"file://{tmp_path}/book", clock := type("C", (), {"now": 0.0, "__call__": lambda s: s.now})())
    b.enqueue(run_windows([(1, 10 * S)], ["t"]))
    monkeypatch.setattr(b, "complete", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        process(spark, b, {"t": src}, "dead")
    monkeypatch.undo()
    dead = b.path(b.items()[0])
    clock.now = 601
    process(spark, b, {"t": src}, "w")
    alive = b.path(b.items()[0])
    folder = tmp_path / "book" / "out" / "t" / "run_id=1"
    assert dead != alive and [p.name for p in folder.iterdir() if p.is_dir()] == [alive.rpartition("/")[2]]
    assert rows(b.results(spark, RESULT)) == WANT[1]


def test_a_long_job_keeps_its_lease(spark, tmp_path):
    b = Ledger(spark, f"file://{tmp_path}/book")
    b.enqueue(run_windows([(1, 10)], ["t"]))
    got = b.lease("slow", None, 1.5)
    with lg._Renewal(b, got, 1.5):
        time.sleep(3)
        assert b.lease("other", None, 60) == []
    b.complete([i.item_id for i in got], got[0].token)
    assert threading.active_count() < 50 and b.items()[0].state == DONE


def test_done_items_and_old_versions_don_t_pile_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lg, "DONE_ITEMS", 3)
    monkeypatch.setattr(lg, "VERSIONS", 4)
    b = Ledger(spark, f"file://{tmp_path}/book")
    runs = [(i, i * 10) for i in range(1, 13)]
    for n in range(1, 13):
        assert b.enqueue(run_windows(runs[:n], ["t"])) == 1
        got = b.lease("w", None, 60)
        assert [i.run_id for i in got] == [n]
        b.complete([got[0].item_id], got[0].token)
    names = b.files.names()
    assert len([n for n in names if n.startswith("v")]) <= 6
    fresh = Ledger(spark, b.root)
    assert sorted(i.run_id for i in fresh.items()) == list(range(1, 13)) and {i.state for i in fresh.items()} == {DONE}
    assert fresh.enqueue(run_windows(runs, ["t"])) == 0
