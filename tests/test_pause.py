"""A capture that is paused reads nothing, and goes on where it stood; data files roll at their target size."""

import json

import pytest
from pyspark.sql import types as T

from rillstone.config import Stream
from rillstone.streaming import capture as cap
from rillstone.table.log import TARGET, Table
from tests.test_capture import TOPIC, message


def put(folder, name, messages):
    folder.mkdir(exist_ok=True)
    names = ("topic", "partition", "offset", "timestamp", "key", "value")
    (folder / name).write_text("".join(json.dumps(dict(zip(names, m))) + "\n" for m in messages))


def test_pause_and_resume(spark, tmp_path, rows):
    c = cap.Capture(spark, TOPIC, f"file://{tmp_path}/users", Stream("debezium", "postgres", examine_interval=1))
    with pytest.raises(RuntimeError):
        c.resume()
    assert not c.pause()
    put(tmp_path / "in", "a.json", [message(0, "c", 1, "a"), message(1, "c", 2, "b")])
    c.start(cap.read_files(spark, str(tmp_path / "in")), str(tmp_path / "check"), once=False).processAllAvailable()
    assert c.resume() is c.query and c.pause() and not c.query.isActive
    put(tmp_path / "in", "b.json", [message(2, "u", 2, "c"), message(3, "d", 1)])
    assert rows(c.table.read()) == [(1, "a"), (2, "b")]
    c.resume().processAllAvailable()
    assert rows(c.table.read()) == [(2, "c")] and c.pause()


def test_files_roll_at_the_target_size(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType())])
    t = Table.create(spark, f"file://{tmp_path}/t", schema, ["id"], None, {TARGET: str(28 * 1000)})
    t.append(spark.range(0, 10_000, 1, 2).selectExpr("id", "'twenty characters txt' text"))
    meta = t.metadata()
    assert len(meta.live(meta.refs["main"])) == 10 and t.read().count() == 10_000
