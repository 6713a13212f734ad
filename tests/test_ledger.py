import pytest

from rillstone.operators.ledger import DONE, PENDING, Ledger, StaleToken, process, run_windows


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        return self.now


@pytest.fixture
def book(spark, tmp_path):
    clock = Clock()
    b = Ledger(spark, f"file://{tmp_path}/book", clock)
    return b, clock


RUNS = [(2, 30), (1, 10), (3, 50), (2, 30)]
RESULT = "run_id bigint, table_name string, row_id bigint"


def records(spark):
    data = [(i, t) for i, t in enumerate([None, 5, 10, 11, 30, 31, 50, 51])]
    return {"t": spark.createDataFrame(data, "row_id bigint, arrived_us bigint")}


WANT = [(1, "t", 1), (1, "t", 2), (2, "t", 3), (2, "t", 4), (3, "t", 5), (3, "t", 6)]


def test_windows_follow_one_another():
    got = run_windows(RUNS, ["t"])
    assert [(i.run_id, i.low, i.high) for i in got] == [(1, None, 10), (2, 10, 30), (3, 30, 50)]


def test_every_record_once(spark, book, rows):
    b, _ = book
    assert b.enqueue(run_windows(RUNS, ["t"])) == 3 and b.enqueue(run_windows(RUNS, ["t"])) == 0
    while process(spark, b, records(spark), "w", most=2):
        pass
    assert rows(b.results(spark, RESULT)) == WANT
    assert process(spark, b, records(spark), "w") == 0
    b.enqueue(run_windows([*RUNS, (4, 60)], ["t"]))
    process(spark, b, records(spark), "w")
    assert rows(b.results(spark, RESULT)) == WANT + [(4, "t", 7)]


def test_crash_after_writing_and_takeover(spark, book, rows, monkeypatch):
    b, clock = book
    b.enqueue(run_windows(RUNS, ["t"]))
    monkeypatch.setattr(b, "complete", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        process(spark, b, records(spark), "dead", seconds=60)
    monkeypatch.undo()
    assert b.results(spark, RESULT).count() == 0 and b.lease("other", 9, 60) == []
    clock.now += 61
    assert process(spark, b, records(spark), "other") == 3
    assert rows(b.results(spark, RESULT)) == WANT


def test_stale_token_is_rejected(book):
    b, clock = book
    b.enqueue(run_windows(RUNS, ["t"]))
    old = b.lease("a", 9, 60)
    b.renew([old[0].item_id], old[0].token, 60)
    clock.now += 61
    new = b.lease("b", 1, 60)
    ids = [i.item_id for i in old]
    for act in (lambda: b.complete(ids, old[0].token), lambda: b.renew(ids, old[0].token, 9), lambda: b.complete(["none"], 1)):
        with pytest.raises(StaleToken):
            act()
    assert new[0].token > old[0].token
    b.complete([new[0].item_id], new[0].token)
    with pytest.raises(StaleToken):
        b.complete([new[0].item_id], new[0].token)
    assert sorted(i.state for i in b.items()) == [DONE, PENDING, PENDING]


def test_writers_at_the_same_time_lose_nothing(spark, book):
    from concurrent.futures import ThreadPoolExecutor

    b, clock = book
    b.enqueue(run_windows([(i, i * 10) for i in range(40)], ["t"]))
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda n: Ledger(spark, b.root, clock).lease(f"w{n}", 5, 60), range(8)))
    ids = [i.item_id for g in got for i in g]
    assert len(ids) == len(set(ids)) == 40 and len({g[0].token for g in got}) == 8


def test_no_runs(spark, book):
    b, _ = book
    assert process(spark, b, records(spark), "w") == 0 and b.results(spark, RESULT).count() == 0
