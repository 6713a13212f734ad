"""Snapshot tables: merge on read, compaction, squashing, picking, conflicts, evolution; with the golden cases."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.table import compact as cp
from rillstone.table.log import DATA, EQ, POS, CommitConflict, File, Snapshot, Table

SCHEMA = T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("data", T.StringType())])


@pytest.fixture
def new(spark, tmp_path):
    def make(schema=SCHEMA, keys=("id",), spec=(), name="t"):
        return Table.create(spark, f"file://{tmp_path}/{name}", schema, list(keys), list(spec))

    return make


def frame(spark, rows, ddl="id int, data string"):
    return spark.createDataFrame(rows, ddl).coalesce(1)


def keys(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id int")


def golden(spark, t):
    t.append(frame(spark, [(1, "first"), (2, "second"), (3, "third")]), {"n": "1"})
    two = t.append(frame(spark, [(4, "fourth"), (5, "fifth"), (6, "sixth"), (7, "seventh")]), {"n": "2"})
    c = t.write_data(frame(spark, [(10, "ten")]))
    pos = t.write_position_deletes(spark.createDataFrame([(c[0].path, 0), (two.added[0].path, 3)], "file_path string, pos bigint"))
    t.commit_files(c + t.write_equality_deletes(keys(spark, [4, 6, 1])) + pos, {"n": "3"})
    t.append(frame(spark, [(6, "six"), (7, "seven")]), {"n": "4"})
    return t


FINAL = [(2, "second"), (3, "third"), (5, "fifth"), (6, "six"), (7, "seven")]


def content(spark, snapshot, kind):
    paths = [f.path for f in snapshot.added if f.content == kind]
    return sorted(tuple(r) for r in spark.read.parquet(*paths).collect()) if paths else []


def test_merge_on_read_and_time_travel(spark, new, rows):
    t = golden(spark, new())
    assert rows(t.read()) == FINAL and len(rows(t.read(2))) == 7 and rows(t.read(3)) == [(2, "second"), (3, "third"), (5, "fifth")]
    t.tag("two", 2)
    assert len(rows(t.read("two"))) == 7
    meta = t.metadata()
    assert rows(t.read(as_of_ms=meta.snapshots[4].ts_ms)) == FINAL and t.read(as_of_ms=0).count() == 0


def test_compact_a_middle_range(spark, new, rows):
    t = golden(spark, new())
    made = cp.compact(t, 1, 3)
    meta = t.metadata()
    chain = meta.ancestors(meta.refs["main"])
    assert made.id == 5 and len(meta.snapshots) == 6 and len(chain) == 3
    assert content(spark, made, DATA) == [(5, "fifth")] and content(spark, made, EQ) == [(1,), (4,), (6,)] and not content(spark, made, POS)
    assert rows(t.read()) == FINAL and rows(t.read(5)) == [(2, "second"), (3, "third"), (5, "fifth")]
    assert made.summary["n"] == "3" and made.summary["squash-snapshots-id"] == "2,3" and chain[0].summary["source-snapshot-id"] == "4"


def test_compact_from_the_root(spark, new, rows):
    t = golden(spark, new())
    made = cp.compact(t, None, 3)
    meta = t.metadata()
    assert content(spark, made, DATA) == [(2, "second"), (3, "third"), (5, "fifth")] and {f.content for f in made.added} == {DATA}
    assert len(meta.ancestors(meta.refs["main"])) == 2 and rows(t.read()) == FINAL


def test_position_deletes_out_of_the_range_are_refused(spark, new):
    t = golden(spark, new())
    with pytest.raises(cp.InvalidCompaction, match="Snapshot 3 contains POSITION_DELETES file reference to out of CompactionGroup"):
        cp.compact(t, 2, 4)
    with pytest.raises(CommitConflict, match="Cannot cherry-pick snapshot 3: Found POSITION_DELETES reference to the dead files"):
        cp.compact(t, None, 2)
    assert len(t.metadata().snapshots) == 4


def test_compact_after_a_migration_keeps_the_high_schema(spark, new, rows):
    t = new()
    t.append(frame(spark, [(1, "first"), (2, "second")]))
    t.append(frame(spark, [(3, "third")]))
    t.rename("data", "payload")
    t.evolve(T.StructType([T.StructField("id", T.IntegerType(), False), T.StructField("payload", T.StringType()), T.StructField("extra", T.StringType())]))
    high = t.row_delta(frame(spark, [(4, "fourth", "x")], "id int, payload string, extra string"), keys(spark, [1]), None)
    made = cp.compact(t, 1, high.id)
    assert made.schema == high.schema == max(t.metadata().schemas)
    assert rows(t.read()) == [(2, "second", None), (3, "third", None), (4, "fourth", "x")]


def test_removed_files_and_ranges_without_rows(spark, new, rows):
    t = new()
    a = t.append(frame(spark, [(1, "first"), (2, "second"), (3, "third")]))
    t.append(frame(spark, [(4, "fourth"), (5, "fifth"), (6, "sixth"), (7, "seventh")]))
    t.commit_files([], removed=[a.added[0].path])
    t.row_delta(None, keys(spark, [4, 1]), None)
    t.row_delta(None, keys(spark, [4, 6]), None)
    t.append(frame(spark, [(4, "four"), (10, "ten")]))
    made = cp.compact(t, 1, 5)
    assert content(spark, made, DATA) == [(5, "fifth"), (7, "seventh")] and content(spark, made, EQ) == [(1,), (4,), (6,)] and made.removed == (a.added[0].path,)
    assert rows(t.read()) == [(10, "ten"), (4, "four"), (5, "fifth"), (7, "seventh")]


def test_net_files_and_operations():
    f = lambda p: File(p, DATA, 1)
    s = lambda i, add, rem: Snapshot(i, i - 1, i, 0, "append", 0, {}, tuple(f(a) for a in add), tuple(rem))
    added, removed = cp.net_files([s(1, ["a", "b"], ["old"]), s(2, ["c"], ["a"]), s(3, [], ["c"])])
    assert [x.path for x in added] == ["b"] and removed == ["old"]
    op = cp.net_operation
    assert [op(["replace", "replace"], 1, 0, 1), op(["append"], 0, 0, 0), op(["append"], 2, 0, 0), op(["append"], 0, 0, 2), op(["append"], 1, 1, 0)] == ["replace", "noop", "append", "delete", "overwrite"]


def test_squash_at_head_middle_tail_and_to_nothing(spark, new, rows):
    t = new()
    for i in range(1, 7):
        t.append(frame(spark, [(i, str(i))]))
    files = t.metadata()
    mid = cp.squash(t, 2, 4, [f for i in (3, 4) for f in files.snapshots[i].added])
    meta = t.metadata()
    assert [s.id for s in meta.ancestors(meta.refs["main"])] == [9, 8, 7, 2, 1] and mid.op == "append"
    assert [i for i, _ in rows(t.read())] == [1, 2, 3, 4, 5, 6]
    head = cp.squash(t, 8, 9, list(meta.snapshots[9].added))
    assert t.metadata().refs["main"] == head.id
    last = t.metadata().refs["main"]
    add = t.append(frame(spark, [(99, "x")]))
    rem = t.commit_files([], removed=[add.added[0].path])
    assert cp.squash(t, last, rem.id, []) is None and t.metadata().refs["main"] == last
    assert [i for i, _ in rows(t.read())] == [1, 2, 3, 4, 5, 6]
    with pytest.raises(cp.InvalidCompaction):
        cp.squash(t, 1, 2, [File("p", POS, 1)])


def test_commits_during_a_compaction_follow_it(spark, new, rows, monkeypatch):
    t = golden(spark, new())
    once = []

    def create(name, text, real=t.files.create):
        if not once:
            once.append(1)
            Table(spark, t.root).append(frame(spark, [(77, "meanwhile")]))
        return real(name, text)

    monkeypatch.setattr(t.files, "create", create)
    cp.compact(t, 1, 3)
    assert rows(t.read()) == sorted(FINAL + [(77, "meanwhile")], key=repr)


def test_conflicts(spark, new, rows):
    t = new()
    a = t.append(frame(spark, [(1, "a"), (2, "b")]))
    pos = spark.createDataFrame([(a.added[0].path, 0)], "file_path string, pos bigint")
    t.append(frame(spark, [(3, "c")]))
    t.row_delta(None, None, pos)  # on a head that has moved on
    assert rows(t.read()) == [(2, "b"), (3, "c")]
    t.truncate()
    assert t.read().count() == 0 and t.read(2).count() == 3
    with pytest.raises(CommitConflict):
        t.row_delta(None, None, pos)
    with pytest.raises(CommitConflict, match="is not an ancestor"):
        t.row_delta(frame(spark, [(9, "z")]), None, None, base=12345, rebase=False)
    with pytest.raises(FileExistsError):
        Table.create(spark, t.root, SCHEMA, ["id"])


def test_writers_at_the_same_time(spark, new):
    t = new()
    files = [t.write_data(frame(spark, [(i, "x")])) for i in range(6)]
    threads = [threading.Thread(target=lambda f=f: Table(spark, t.root).commit_files(f)) for f in files]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert t.read().count() == 6 and len({s.seq for s in t.metadata().snapshots.values()}) == 6


def test_partitions_spec_changes_and_odd_values(spark, new, rows):
    t = new(spec=["data", "truncate[10](id)"])
    data = [(1, "a b+c%/d"), (2, None), (33, "é"), (34, "")]
    t.append(frame(spark, data))
    t.row_delta(frame(spark, [(2, "again")]), keys(spark, [2, 33]), None)
    assert rows(t.read()) == sorted([(1, "a b+c%/d"), (2, "again"), (34, "")], key=repr)
    live = t.metadata().live(t.metadata().refs["main"])
    some = {f.partition for f in live if f.content == DATA and "truncate" not in f.partition and "again" in f.partition}
    assert rows(t.read(partitions=some)) == [(2, "again")]
    t.respec([])
    t.append(frame(spark, [(5, "five")]))
    with pytest.raises(cp.InvalidCompaction, match="spec"):
        cp.compact(t, None, 3)
    cp.compact(t, None, 2)
    assert len(rows(t.read())) == 4


def test_fan_out_and_clustered_writes_hold_the_same(spark, new, rows):
    df = spark.range(200).select(F.col("id").cast("int"), (F.col("id") % 5).cast("string").alias("data")).repartition(4)
    t = new(spec=["data"])
    fan, clustered = t.write_data(df), t.write_data(df, clustered=True)
    assert len(clustered) == 5 <= len(fan)
    t.commit_files(clustered)
    assert t.read().count() == 200


def test_reads_by_field_id_and_wider_types(spark, new, rows):
    deep = T.StructType.fromDDL("id int, s struct<a:int,b:string>, l array<struct<x:float>>, m map<string,int>, d decimal(5,2)")
    t = new(deep)
    t.append(spark.sql("select 1 id, named_struct('a', 1, 'b', 'x') s, array(named_struct('x', cast(1.5 as float))) l, map('k', 1) m, cast(1.25 as decimal(5,2)) d"))
    wide = T.StructType.fromDDL("id bigint, s struct<c:string,a:bigint>, l array<struct<x:double,y:int>>, m map<string,bigint>, d decimal(10,2)")
    changes = t.evolve(wide)
    assert {(c.kind, c.path) for c in changes} >= {("promote", "id"), ("drop", "s.b"), ("add", "s.c"), ("promote", "l.element.x"), ("add", "l.element.y"), ("promote", "m.value"), ("promote", "d")}
    r = t.read().first()
    assert r.id == 1 and r.s.a == 1 and r.s.c is None and r.l[0].x == 1.5 and r.l[0].y is None and r.m == {"k": 1} and str(r.d) == "1.25"
    assert t.evolve(wide) == []


def test_cherry_pick_moves_or_copies(spark, new, rows):
    t = new()
    a = t.append(frame(spark, [(1, "a")]))
    b = t.append(frame(spark, [(2, "b")]))
    t.commit(lambda m: m.refs.update(main=a.id))
    assert cp.cherry_pick(t, b.id).id == b.id and rows(t.read()) == [(1, "a"), (2, "b")]
    t.commit(lambda m: m.refs.update(main=a.id))
    t.append(frame(spark, [(3, "c")]))
    made = cp.cherry_pick(t, b.id)
    assert made.summary["source-snapshot-id"] == str(b.id) and len(rows(t.read())) == 3


def test_orc_tables_and_mixed_formats(spark, tmp_path, rows):
    t = Table.create(spark, f"file://{tmp_path}/orc", SCHEMA, ["id"], [], {"write.format.default": "ORC"})
    a = t.append(frame(spark, [(1, "a"), (2, "b")]))
    assert a.added[0].format == "orc" and a.added[0].bytes > 0
    t.commit(lambda m: m.properties.update({"write.format.default": "parquet"}))
    t.row_delta(frame(spark, [(1, "c"), (3, "d")]), keys(spark, [1]), None)
    assert rows(t.read()) == [(1, "c"), (2, "b"), (3, "d")]
    with pytest.raises(ValueError, match="Parquet"):
        t.row_delta(None, None, spark.createDataFrame([(a.added[0].path, 0)], "file_path string, pos bigint"))
    cp.compact(t, None, 2)
    assert rows(t.read()) == [(1, "c"), (2, "b"), (3, "d")]


def test_failed_writes_leave_no_files(spark, new, tmp_path):
    t = new()
    t.append(frame(spark, [(1, "a")]))
    bad = spark.createDataFrame([("nowhere/data/x.parquet", 0)], "file_path string, pos bigint")
    with pytest.raises(CommitConflict):
        t.row_delta(frame(spark, [(2, "b")]), None, bad)
    assert t.unreferenced(2**62) == []
    t.write_data(frame(spark, [(3, "c")]))
    assert len(t.unreferenced(2**62)) == 1 and t.unreferenced(0) == [] and t.clean(2**62) == 1 and t.read().count() == 1


def test_raw_scans_and_groups(spark, new, rows):
    from rillstone.table.log import by_partition

    t = new(spec=["data"])
    t.row_delta(frame(spark, [(1, "a"), (2, "b")]), keys(spark, [7, 8]), None)
    t.row_delta(frame(spark, [(3, "a")]), keys(spark, [9]), None)
    assert rows(t.scan(EQ)) == [(7,), (8,), (9,)] and rows(t.scan(EQ, "c1 > 7", after_seq=1)) == [(9,)] and t.scan(POS).count() == 0
    assert sorted(len(v) for v in by_partition(t.metadata().live(2)).values()) == [1, 2]


def test_catalog(spark, tmp_path, rows):
    from rillstone.table.catalog import Catalog

    c = Catalog(spark, f"file://{tmp_path}/lake")
    assert c.tables("shop.public") == []
    t = c.create("shop.public.users", SCHEMA, ["id"])
    t.append(frame(spark, [(1, "a")]))
    assert c.tables("shop.public") == ["shop.public.users"] and c.load("shop.public.users") is t and Catalog(spark, c.root).load("shop.public.users").read().count() == 1
    c.view("shop.public.users")
    assert rows(spark.sql("select * from shop_public_users")) == [(1, "a")]
    c.drop("shop.public.users")
    assert not c.exists("shop.public.users")
    for bad, error in (("shop.none", FileNotFoundError), ("users", ValueError)):
        with pytest.raises(error):
            c.load(bad)
