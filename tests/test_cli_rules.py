"""The commands: when a topic is due, which topics and tables they look at."""

import json
from dataclasses import replace

import pytest

from rillstone import cli
from rillstone.config import load_config
from rillstone.table.log import Table
from tests.test_capture import GOLD, YAML


def put(folder, name, messages):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(["topic", "partition", "offset", "timestamp", "key", "value"], m))) + "\n" for m in messages))


@pytest.fixture
def config(tmp_path):
    def make(warehouse):
        p = tmp_path / "c.yaml"
        p.write_text(YAML % warehouse)
        return load_config(str(p))

    return make


def test_a_topic_waits_until_it_is_due(spark, tmp_path, config):
    c, source = config(tmp_path / "lake"), tmp_path / "in"
    cli.stream(spark, c, str(source), forever=False)  # no folder yet
    put(source, "a.json", GOLD)
    cli.stream(spark, c, str(source), forever=False)
    t = Table(spark, str(tmp_path / "lake/shop/users"))
    head = t.metadata().last_snapshot
    m = list(GOLD[0])
    m[2] = 1 + max(x[2] for x in GOLD)
    put(source, "b.json", [tuple(m)])
    c.stream = replace(c.stream, commit_timespan=1e12)
    cli.stream(spark, c, str(source), forever=False)
    assert t.metadata().last_snapshot == head
    c.stream = replace(c.stream, commit_timespan=0)
    cli.stream(spark, c, str(source), forever=False)
    assert t.metadata().last_snapshot == head + 1


def test_manage_finds_tables_by_any_address(spark, tmp_path, config):
    put(tmp_path / "in", "a.json", GOLD)
    c = config(f"file:{tmp_path}/lake")  # no path that the driver could list
    cli.stream(spark, c, f"file:{tmp_path}/in", forever=False)
    t = Table(spark, str(tmp_path / "lake/shop/users"))
    n = len(t.metadata().ancestors(t.metadata().refs["main"]))
    cli.manage(spark, c, forever=False)
    assert n > 1 and len(t.metadata().ancestors(t.metadata().refs["main"])) == 1


def test_kafka_without_a_list_of_topics_is_an_error(spark, tmp_path, config):
    with pytest.raises(ValueError, match="topicsIncluded"):
        cli.stream(spark, config(tmp_path / "lake"), None, forever=False)
