import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.config import Compaction, Expiration
from rillstone.table import upkeep as up
from rillstone.table.log import TS, Metadata, Snapshot, Table

UTC = timezone.utc


def ms(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp() * 1000)


def test_points_and_keys(spark):
    p = up.Points.at(datetime(2022, 7, 15, 12, 14, 16, 432000, UTC), Compaction())
    assert [x.strftime("%Y-%m-%dT%H") for x in (p.hour, p.day, p.month, p.year)] == ["2022-07-15T09", "2022-07-14T00", "2022-06-01T00", "2021-01-01T00"]
    times = ["2022-07-15T10:00:00", "2022-07-15T08:59:00", "2022-07-13T10:00:00", "2022-05-31T00:00:00", "2020-12-31T23:59:59", "2022-07-15T09:00:00.120"]
    want = ["2022-07-15T10:00:00", "2022-07-15T08", "2022-07-13", "2022-05", "2020", "2022-07-15T09:00:00.120"]
    assert [p.key(ms(t)) for t in times] == want
    df = spark.createDataFrame([(ms(t),) for t in times], "t bigint")
    assert [r[0] for r in df.select(p.key_column(F.col("t"))).collect()] == want
    q = up.Points.at(datetime(2021, 12, 25, 19, 20, 45, 78000, UTC), Compaction(UTC, 3, 12, 15, 6))
    assert [x.strftime("%m-%dT%H") for x in (q.hour, q.day, q.month)] == ["12-25T16", "12-25T00", "12-01T00"] and q.year == datetime(2021, 1, 1, tzinfo=UTC)


def snaps(n, key=lambda i: i):
    return [Snapshot(i, i - 1 if i > 1 else None, i, 0, "append", 0, {TS: str(key(i))}) for i in range(n, 0, -1)]


def test_groups(spark):
    chain = [s for s in snaps(10) if s.id >= 2]
    chain = [Snapshot(s.id, s.parent if s.id > 2 else None, s.seq, 0, "append", 0) for s in chain]
    key = lambda s: "a" if s.id <= 3 else "b" if s.id <= 5 else "c"
    assert [(g.size, g.low, g.high) for g in up.groups(chain, key)] == [(5, 5, 10), (2, 3, 5), (2, None, 3)]
    df = spark.createDataFrame([(s.id, key(s)) for s in chain], "i bigint, k string")
    assert sorted((r["size"], r.low or 0, r.high) for r in up.groups_of(df, F.col("k"), "i", "i").collect()) == [(2, 0, 3), (2, 3, 5), (5, 5, 10)]
    assert up.groups([], key) == []


def test_day_tags_stop_at_the_first_group_that_is_not_ready():
    p = up.Points.at(datetime(2022, 7, 15, 12, tzinfo=UTC), Compaction())
    at = {1: "2022-07-01T05:00:00", 2: "2022-07-02T05:00:00", 3: "2022-07-03T01:00:00", 4: "2022-07-03T02:00:00", 5: "2022-07-04T01:00:00"}
    assert up.day_tags(snaps(5, lambda i: ms(at[i])), p, ["2022-07-01"]) == [("2022-07-02", 2)]
    assert up.day_tags(snaps(2, lambda i: ms(["", "2022-07-13T01:00:00", "2022-07-14T01:00:00"][i])), p, []) == [("2022-07-13", 1)]


def test_orphans_older_than_the_age():
    s = {i: Snapshot(i, p, i, i * 1000, "append", 0) for i, p in [(1, None), (2, 1), (3, 1), (4, 3), (5, 2)]}
    meta = Metadata({}, 0, 0, [], {}, 0, {}, s, {"main": 2})
    assert up.orphans(meta, 6000, 1500) == [3, 4] and up.orphans(meta, 6000, 1500, recent_only=True) == [5]
    meta.refs["kept"] = 4
    assert up.orphans(meta, 6000, 0) == [5]


@pytest.fixture
def table(spark, tmp_path):
    t = Table.create(spark, f"file://{tmp_path}/t", T.StructType.fromDDL("id int, v string"), ["id"])
    for i, at in enumerate(["2022-06-20T01:00:00", "2022-06-20T02:00:00", "2022-06-21T01:00:00", "2022-07-15T07:10:00", "2022-07-15T07:20:00", "2022-07-15T11:00:00"]):
        t.row_delta(spark.createDataFrame([(i, at), (100, str(i))], "id int, v string"), spark.createDataFrame([(100,)], "id int"), None, {TS: str(ms(at))})
    return t


def test_manager_compacts_tags_and_expires(spark, table, rows, tmp_path):
    before, now = rows(table.read()), datetime(2022, 7, 15, 12, tzinfo=UTC)
    m = up.Manager({"t": table}, Compaction(), Expiration(True, 0))
    for _ in range(2):
        m.examine(now)
        m.lanes.close()
        assert not m.lanes.failures
        m = up.Manager({"t": table}, Compaction(), Expiration(True, -1e12))
    meta = table.metadata()
    assert rows(table.read()) == before and len(meta.ancestors(meta.refs["main"])) == 4
    assert set(meta.refs) == {"main", "2022-06-20", "2022-06-21"} and len(rows(table.read("2022-06-20"))) == 3
    assert up.expire(table, Expiration(True, -1e12)) == [] and len(meta.snapshots) == 4
    used = {f.path for s in meta.snapshots.values() for f in s.added}
    there = {str(p) for p in tmp_path.rglob("part-*.parquet") if p.name.startswith("part")}
    assert len(there) - len(used) <= 1  # an empty file of a rewrite may be left


def test_lanes_run_in_order_and_go_on_after_failures():
    seen, told = [], []

    def run(key, item):
        time.sleep(0.005)
        seen.append((key, item))
        if item == 1:
            raise RuntimeError("no")

    lanes = up.Lanes(run, 4)
    lanes.listeners.append(lambda *a: told.append(a[:2]))
    for i in range(4):
        for k in "ab":
            lanes.enqueue(k, i)
    lanes.close()
    for k in "ab":
        assert [i for key, i in seen if key == k] == [0, 1, 2, 3] and lanes.is_empty(k) and lanes.queue_size(k) == 0 and lanes.running_item(k) is None
    assert len(lanes.failures) == 2 and len(told) == 8


def test_offsets_of_time_zones():
    p = up.Points.at(datetime(2022, 7, 15, 12, tzinfo=UTC), Compaction(timezone(timedelta(hours=7))))
    assert p.key(ms("2020-12-31T18:00:00")) == "2021-01" and p.key(ms("2020-12-31T16:00:00")) == "2020"
