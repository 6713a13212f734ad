"""Capture end to end: commits, recovery, schema changes, truncates, tombstones, streaming, configuration, topics."""

import json
import time
from datetime import timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone import cli
from rillstone.config import Stream, load_config, parse
from rillstone.schema import derive
from rillstone.sources import changelog, topics
from rillstone.streaming import capture as cap
from rillstone.table.log import OFFSETS, Table

TOPIC = "pg.public.users"
MESSAGE = "topic string, partition int, offset bigint, timestamp timestamp, key string, value string"


def struct(text):
    kinds = {"int": T.IntegerType(), "bigint": T.LongType(), "string": T.StringType()}
    parts = [x.split() for x in text.split(",")]
    return T.StructType([T.StructField(p[0], kinds[p[1]], len(p) == 2) for p in parts])


def message(offset, op, i, v=None, *, ts=None, lsn=None, row="id int not null, v string", version=1, partition=0, topic=TOPIC, source=None):
    one = derive.message_schema(struct(row))
    schema = {"type": "struct", "version": version, "fields": [{**one, "field": "before", "optional": True}, {**one, "field": "after", "optional": True}]}
    key = {"type": "struct", "fields": [{"field": "id", "type": "int32", "optional": False}]}
    ts = ts if ts is not None else 1_700_000_000_000 + offset
    after = None if op in ("d", "t") else {"id": i, "v": v} if not isinstance(v, dict) else {"id": i, **v}
    payload = {"op": op, "before": {"id": i} if op in ("u", "d") else None, "after": after, "source": source or {"ts_ms": ts, "lsn": lsn if lsn is not None else offset + 1}, "ts_ms": ts}
    value = None if op is None else json.dumps({"schema": schema, "payload": payload})
    return (topic, partition, offset, None, json.dumps({"schema": key, "payload": {"id": i}}), value)


@pytest.fixture
def make(spark, tmp_path):
    def run(size=100, **k):
        return cap.Capture(spark, TOPIC, f"file://{tmp_path}/users", Stream("debezium", k.pop("connector", "postgres"), commit_batch_size=size, **k))

    return run


def df(spark, messages):
    return spark.createDataFrame(messages, MESSAGE)


GOLD = [message(n, *x) for n, x in enumerate([("c", 1, "aaa"), ("c", 2, "bbb"), ("c", 3, "ccc"), ("u", 2, "ddd"), ("u", 1, "eee"), ("c", 4, "fff"), ("c", 5, "ggg"), ("d", 3), (None, 3), ("u", 2, "hhh"), ("u", 5, "iii"), ("d", 4)])]
WANT = [(1, "eee"), (2, "hhh"), (5, "iii")]


@pytest.mark.parametrize("size", [100, 3, 1])
def test_commits_of_any_size(spark, make, rows, size):
    c = make(size)
    assert c(df(spark, GOLD)) == {100: 1, 3: 4, 1: 11}[size]
    assert rows(c.table.read()) == WANT and json.loads(c.table.summary_of(OFFSETS)) == {"0": 12}
    m = c.metrics
    assert (m["creates"], m["updates"], m["deletes"], m["reads"], m["out_of_order"], m["maybe_duplicates"]) == (5, 4, 2, 0, 0, 0) and m["commits"] == {100: 1, 3: 4, 1: 11}[size]


@pytest.mark.parametrize("cut", range(0, 13, 3))
def test_replayed_micro_batches_change_nothing(spark, make, rows, cut):
    c = make(4)
    c(df(spark, GOLD[:cut] or GOLD[:1]))
    c(df(spark, GOLD[: cut + 3]))
    assert c(df(spark, GOLD)) >= 0 and rows(c.table.read()) == WANT
    assert c(df(spark, GOLD)) == 0


def test_crash_between_commits(spark, make, rows, monkeypatch):
    c, n = make(2), []

    def commit(files, summary, real=Table.commit_files):
        n.append(1)
        if len(n) == 3:
            raise KeyboardInterrupt
        return real(c.table, files, summary)

    c(df(spark, GOLD[:1]))
    monkeypatch.setattr(c.table, "commit_files", commit)
    with pytest.raises(KeyboardInterrupt):
        c(df(spark, GOLD))
    again = make(2)
    again(df(spark, GOLD))
    assert rows(again.table.read()) == WANT


def test_tombstones_and_truncates(spark, make, rows):
    c = make(1)
    assert c(df(spark, [message(0, None, 2)])) == 0 and not c.table.exists()
    assert c(df(spark, [message(0, None, 2), message(1, "c", 2, "x")])) == 1 and rows(c.table.read()) == [(2, "x")]
    assert c(df(spark, [message(2, "c", 3, "y"), message(3, "t", 0), message(4, "c", 4, "z")])) == 3
    assert rows(c.table.read()) == [(4, "z")] and json.loads(c.table.summary_of(OFFSETS)) == {"0": 5}
    c(df(spark, [message(5, "t", 0)]))
    assert c.table.read().count() == 0


def test_schema_changes_cut_commits_and_migrate(spark, make, rows):
    c = make()
    wide = "id bigint not null, v int, w string"
    got = c(df(spark, [message(0, "c", 1, "a"), message(1, "c", 2, "b"), message(2, "u", 2, {"v": 5, "w": "x"}, row=wide, version=2), message(3, "c", 3, {"v": 6, "w": None}, row=wide, version=2)]))
    assert got == 2 and rows(c.table.read()) == [(1, None, None), (2, 5, "x"), (3, 6, None)]
    c(df(spark, [message(4, "c", 4, {"v": 7, "w": "y"}, row=wide, version=2)]))
    assert len(c.table.metadata().schemas) == 2


def test_days_rotate_at_the_configured_offset(spark, make):
    c = make(rotate_tz=timezone(timedelta(hours=7)))
    day = 86_400_000
    assert c(df(spark, [message(0, "c", 1, "a", ts=day * 10 + 17 * 3_600_000 - 1), message(1, "c", 2, "b", ts=day * 10 + 17 * 3_600_000), message(2, "c", 3, "c", ts=day * 11)])) == 2


def test_partitions_merge_by_time_and_binlog_positions_count(spark, make, rows):
    c = make(connector="mysql")
    src = lambda ts, f, p: {"ts_ms": ts, "file": f, "pos": p}
    c(df(spark, [message(0, "c", 1, "a", source=src(1, "b.999999", 9)), message(0, "u", 1, "c", source=src(3, "x.1000000", 2), partition=1), message(1, "u", 1, "b", source=src(2, "x.1000000", 1))]))
    assert rows(c.table.read()) == [(1, "c")]
    c(df(spark, [message(2, "c", 1, "a again", source=src(3, "b.999999", 9))]))
    assert len(rows(c.table.read())) == 1  # a create behind the marks replaces


def test_records_without_key_are_an_error(spark, make):
    m = list(message(0, "c", 1, "a"))
    m[4] = None
    with pytest.raises(ValueError, match="without key"):
        make()(df(spark, [tuple(m)]))


def test_streaming_from_files_restarts_where_it_was(spark, make, rows, tmp_path):
    def put(name, messages):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps(dict(zip(["topic", "partition", "offset", "timestamp", "key", "value"], m))) + "\n" for m in messages))

    put("a.json", GOLD[:6])
    from rillstone.streaming.progress import Progress

    progress = Progress()
    spark.streams.addListener(progress)
    for name, more in (("b.json", GOLD[4:]), (None, None)):
        c = make(3)
        q = c.start(cap.read_files(spark, str(tmp_path / "in")), str(tmp_path / "check"))
        q.awaitTermination()
        assert q.exception() is None
        if name:
            put(name, more)
    assert rows(c.table.read()) == WANT
    for _ in range(100):  # listeners hear of it a little later
        if progress.counts[TOPIC]["ended"] == 2:
            break
        time.sleep(0.1)
    spark.streams.removeListener(progress)
    assert progress.counts[TOPIC]["rows"] == 6 + len(GOLD[4:]) and progress.counts[TOPIC]["failures"] == 0


def test_when_to_run_and_when_to_end():
    s = Stream("debezium", "mysql")
    now = 10_000_000_000
    assert not cap.should_run(0, None, now, s) and cap.should_run(1001, now, now, s) and not cap.should_run(5, now - 1, now, s) and cap.should_run(5, now - 600_001, now, s)
    assert cap.can_end(True, 0, now - 900_001, now, s) and not cap.can_end(True, 1, 0, now, s) and not cap.can_end(False, 0, 0, now, s)


def test_offsets_and_lag(spark, rows):
    latest = spark.createDataFrame([(0, 10), (1, 5)], "part int, next bigint")
    done = spark.createDataFrame([(0, 4)], "part int, next bigint")
    assert rows(changelog.lag(latest, done)) == [(0, 10, 4, 6), (1, 5, 0, 5)]
    assert rows(changelog.resume_offsets(done, latest)) == [(0, 4, True), (1, 5, False)]
    log = spark.createDataFrame([(0, 3), (0, 4), (1, 0)], "kafka_partition int, kafka_offset bigint")
    assert rows(changelog.unread(log, done)) == [(0, 4), (1, 0)]


def test_envelopes_decode_and_tombstones_stay(spark):
    row, key = T.StructType.fromDDL("id int, v string"), T.StructType.fromDDL("id int")
    raw = spark.createDataFrame([(0, '{"id":1}', '{"op":"c","after":{"id":1,"v":"x"},"source":{"ts_ms":5,"lsn":7},"ts_ms":6}'), (1, '{"id":1}', None), (2, "broken", "broken")], "kafka_offset bigint, key string, value string")
    a, b, c = changelog.decode_json(raw, row, key).orderBy("kafka_offset").collect()
    assert a.op == "c" and a.after.v == "x" and a.source.lsn == 7 and b.op is None and b.key.id == 1 and c.op is None
    assert "kafka_offset" in changelog.envelope(row, key).names
    assert spark.range(1).select(changelog.schema_version(F.lit(1), F.lit(2))).first()[0] == "key=1,value=2"


def test_converters_by_name():
    f, options = changelog.converter({"value.converter": "any.vendor.AvroConverter", "value.converter.schema.registry.url": "http://r", "key.converter.x": "1"}, "value")
    assert f is changelog.decode_avro and options == {"schema.registry.url": "http://r"}
    assert changelog.converter({}, "key")[0] is changelog.decode_json
    with pytest.raises(ValueError):
        changelog.converter({"key.converter": "nope"}, "key")


def test_topics_and_names(spark, rows):
    t = spark.createDataFrame([(x,) for x in ["p.a.b", "p.a.b.c", "p.a", "q.a.b", "p.x.y"]], "topic string")
    assert rows(topics.available(t, "topic", "p.", exclude=["p.x.y"])) == [("p.a.b",), ("p.a.b.c",)]
    assert rows(topics.available(t, "topic", "p.", include=["q.a.b"], exclude=["q.a.b"])) == [("q.a.b",)]
    ns, name = topics.table_id(F.col("topic"), "p.")
    assert rows(t.select(ns, name)) == sorted([("a", "b"), ("a.b", "c"), (None, None), ("q.a", "b"), ("x", "y")], key=repr)
    chain = topics.Chain(topics.ChangeCase("upper", None, "lower"), topics.MapNamespaces({"A": "z.w"}))
    assert rows(spark.createDataFrame([("a", "Tb"), ("b", "c")], "n string, t string").select(chain.namespace(F.col("n")), chain.table(F.col("t")), chain.column(F.col("t")))) == [("B", "c", "c"), ("z.w", "Tb", "tb")]


YAML = """
source: {kind: kafka, topicPrefix: pg., topicsExcluded: [pg.x.y], config: {poll.timeout.ms: 500}, namingAdjusters: [{case: lower}, {map: {public: shop}}]}
sink: {kind: files, catalog: {warehouse: %s}, tableCreation: {properties: {a: 1}, partitionSpec: {users: [{column: id, transform: "truncate[50]", name: t}]}}}
stream: {kind: debezium, connector: postgres, examineInterval: 1m, commitBatchSize: 4, rotateByDateInTz: "+07"}
manager: {namespace: [shop], compactSnapshots: {tz: "-03:30", retainRaw: 1}, expireOrphanSnapshots: {age: 2h}}
"""


def test_configuration(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text(YAML % tmp_path)
    c = load_config(str(p))
    assert c.source.poll_timeout == 0.5 and c.sink.partition_spec == {"users": ["truncate[50](id)"]} and c.stream.examine_interval == 60 and c.stream.commit_batch_size == 4
    assert c.stream.idle_timeout == 900 and c.stream.rotate_tz == timezone(timedelta(hours=7)) and c.manager.compaction.tz == timezone(-timedelta(hours=3, minutes=30))
    assert c.manager.compaction.retain_raw == 1 and c.manager.compaction.retain_hour == 24 and c.manager.expiration.age == 7200
    for bad in ({"source": {"kind": "", "topicPrefix": "x"}, "sink": {"kind": "s"}, "stream": {"kind": "d", "connector": "m"}},):
        with pytest.raises(ValueError):
            parse(bad)


def test_both_commands(spark, rows, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("".join(json.dumps(dict(zip(["topic", "partition", "offset", "timestamp", "key", "value"], m))) + "\n" for m in GOLD))
    p = tmp_path / "c.yaml"
    p.write_text(YAML % (tmp_path / "lake"))
    c = load_config(str(p))
    cli.stream(spark, c, str(tmp_path / "in"), forever=False)
    t = Table(spark, str(tmp_path / "lake/shop/users"))
    assert rows(t.read()) == WANT and t.metadata().specs[0] == ["truncate[50](id)"] and t.metadata().properties["a"] == "1"
    n = len(t.metadata().ancestors(t.metadata().refs["main"]))
    cli.manage(spark, c, forever=False)
    meta = t.metadata()
    assert n > 1 and len(meta.ancestors(meta.refs["main"])) == 1 and rows(t.read()) == WANT
