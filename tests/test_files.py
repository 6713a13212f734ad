"""Metadata files on file systems that aren't local: whole or not there at all."""

import uuid
from pathlib import Path

import pytest
from pyspark.sql import types as T

from rillstone.files import Files
from rillstone.operators.ledger import Ledger, run_windows
from rillstone.session import shared_dir
from rillstone.table.log import Table


@pytest.fixture
def mounted(spark, tmp_path):
    """A folder by way of a mount table, which is no local file system, and its address."""
    name = f"t{uuid.uuid4().hex[:8]}"
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{name}.link./at", f"file://{tmp_path}")
    return tmp_path, f"viewfs://{name}/at"


def test_a_file_is_created_once(spark, mounted):
    folder, at = mounted
    f = Files(spark, f"{at}/x")
    assert f.create("a.json", "one\n") and not f.create("a.json", "two\n") and f.read("a.json") == "one\n"
    assert f.names() == ["a.json"] and [p.name for p in (folder / "x").iterdir() if not p.name.startswith(".")] == ["a.json"]


def test_only_whole_files_count(spark, mounted):
    folder, at = mounted
    f = Files(spark, f"{at}/x")
    assert f.latest("v") == (0, None)
    f.create("v1.json", "one\n")
    (folder / "x" / ".new-dead").write_text("to")
    (folder / "x" / "v2.json").write_text("to")
    assert f.latest("v") == (2, "one\n")
    f.create("v3.json", "three\n")
    assert f.latest("v") == (3, "three\n")


def dies(monkeypatch, f):
    """A writer that dies between creating a file and closing it."""
    real = f.fs

    class Dying:
        def __getattr__(self, name):
            return getattr(real, name)

        def create(self, path, over):
            real.create(path, over)  # never written to, never closed
            raise KeyboardInterrupt

    f.fs = Dying()


def test_a_ledger_survives_a_writer_that_dies(spark, mounted, monkeypatch):
    folder, at = mounted
    book = Ledger(spark, f"{at}/book")
    book.enqueue(run_windows([(1, 10), (2, 20)], ["t"]))
    other = Ledger(spark, f"{at}/book")
    dies(monkeypatch, other.files)
    with pytest.raises(KeyboardInterrupt):
        other.lease("dead", None, 60)
    (folder / "book" / "ledger" / "v000000000009.json").write_text('{"token": 7, "ite')
    got = book.lease("w", None, 60)
    assert [i.run_id for i in got] == [1, 2]
    book.complete([i.item_id for i in got], got[0].token)
    assert {i.state for i in Ledger(spark, f"{at}/book").items()} == {"done"}


def test_a_table_survives_a_writer_that_dies(spark, mounted, monkeypatch, rows):
    folder, at = mounted
    t = Table.create(spark, f"{at}/t", T.StructType([T.StructField("id", T.LongType())]), ["id"])
    t.append(spark.range(3))
    other = Table(spark, f"{at}/t")
    other.metadata()
    dies(monkeypatch, other.files)
    with pytest.raises(KeyboardInterrupt):
        other.truncate()
    (folder / "t" / "metadata" / "v0000000009.json").write_text('{"schemas": ')
    assert rows(t.read()) == [(0,), (1,), (2,)]
    t.append(spark.range(3, 5))
    assert rows(Table(spark, f"{at}/t").read()) == [(0,), (1,), (2,), (3,), (4,)]


def test_a_commit_writes_what_is_new_and_no_more(spark, tmp_path):
    t = Table.create(spark, f"file://{tmp_path}/t", T.StructType([T.StructField("id", T.LongType())]), ["id"])
    sizes = []
    for n in range(4):
        before = {p.name for p in Path(f"{tmp_path}/t/metadata").iterdir()}
        t.truncate({"n": "x" * 5000})
        new = [p for p in Path(f"{tmp_path}/t/metadata").iterdir() if p.name not in before]
        sizes.append(sum(p.stat().st_size for p in new))
        assert sorted(p.name[0] for p in new) == ["s", "v"]
    assert sizes[-1] - sizes[0] < 1000
    assert [s.id for s in Table(spark, t.root).metadata().ancestors(4)] == [4, 3, 2, 1]


class Conf:
    def __init__(self, **conf):
        self.conf = {k.replace("__", "."): v for k, v in conf.items()}


def test_a_cluster_has_to_name_its_shared_folder():
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(Conf(spark__master=master))
        assert shared_dir(Conf(spark__master=master, spark__checkpoint__dir="s3a://b/x/")) == "s3a://b/x"
    assert shared_dir(Conf(spark__master="local[4]")).startswith("file:")
