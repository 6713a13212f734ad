"""Avro values against bytes of the specification, and round trips through frames."""

import json
from datetime import date, datetime, timezone
from decimal import Decimal
from io import BytesIO

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstone.sources import avro, changelog


def to_bytes(schema, v):
    out = bytearray()
    avro.writer(json.dumps(schema))(v, out)
    return bytes(out)


def back(schema, data):
    return avro.reader(json.dumps(schema))(BytesIO(data))


@pytest.mark.parametrize(
    "schema,value,data",
    [
        ("long", 0, "00"), ("long", -1, "01"), ("long", 1, "02"), ("long", -64, "7f"), ("long", 64, "8001"), ("long", -(2**63), "ffffffffffffffffff01"), ("boolean", True, "01"), ("string", "foo", "06666f6f"),
        ("float", 1.0, "0000803f"), ("double", 1.0, "000000000000f03f"), ("bytes", b"\x01", "0201"),
        ({"type": "record", "name": "test", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": "string"}]}, {"a": 27, "b": "foo"}, "3606666f6f"),
        ({"type": "array", "items": "long"}, [3, 27], "04063600"), (["null", "string"], None, "00"), (["null", "string"], "a", "020261"), ({"type": "enum", "name": "e", "symbols": ["x", "y"]}, "y", "02"),
        ({"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}, Decimal("-1.00"), "029c"), ({"type": "int", "logicalType": "date"}, date(1970, 1, 3), "04"),
    ],
)
def test_bytes_of_the_specification(schema, value, data):
    assert to_bytes(schema, value).hex() == data and back(schema, bytes.fromhex(data)) == value


ROW = {
    "type": "record", "name": "row", "namespace": "a.b",
    "fields": [
        {"name": "id", "type": "long"}, {"name": "name", "type": ["null", "string"]}, {"name": "price", "type": {"type": "bytes", "logicalType": "decimal", "precision": 20, "scale": 3}},
        {"name": "at", "type": ["null", {"type": "long", "logicalType": "timestamp-micros"}]}, {"name": "tags", "type": {"type": "array", "items": ["null", "string"]}}, {"name": "props", "type": {"type": "map", "values": "double"}},
        {"name": "by", "type": {"type": "array", "logicalType": "map", "items": {"type": "record", "name": "pair", "fields": [{"name": "key", "type": "int"}, {"name": "value", "type": "string"}]}}},
        {"name": "either", "type": ["null", "long", "string"]}, {"name": "kind", "type": {"type": "enum", "name": "kind", "symbols": ["p", "q"]}}, {"name": "inner", "type": ["null", {"type": "record", "name": "inner", "fields": [{"name": "f", "type": "float"}, {"name": "k", "type": "kind"}]}]},
        {"name": "raw", "type": {"type": "fixed", "name": "four", "size": 4}},
    ],
}
ROWS = [
    {"id": 1, "name": "é", "price": Decimal("12.345"), "at": datetime(2024, 5, 1, 1, 2, 3, 456, tzinfo=timezone.utc), "tags": ["x", None], "props": [("a", 1.5)], "by": [(7, "s")], "either": {"member1": "t"}, "kind": "q", "inner": {"f": 0.5, "k": "p"}, "raw": b"abcd"},
    {"id": -5, "name": None, "price": Decimal("-0.001"), "at": None, "tags": [], "props": [], "by": [], "either": None, "kind": "p", "inner": None, "raw": b"\x00" * 4},
    {"id": 2**62, "name": "", "price": Decimal("99999999999999999.999"), "at": None, "tags": [""], "props": [("", -1.0), ("b", 0.0)], "by": [], "either": {"member0": 3}, "kind": "p", "inner": None, "raw": b"\xff" * 4},
]


def test_every_type_there_and_back():
    for r in ROWS:
        assert back(ROW, to_bytes(ROW, r)) == r


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-(2**63), 2**63 - 1), st.none() | st.text(), st.binary(), st.booleans()), max_size=20), st.sampled_from(["null", "deflate"]), st.integers(1, 7))
def test_container_files(rows, codec, block):
    schema = json.dumps({"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}, {"name": "c", "type": "bytes"}, {"name": "d", "type": "boolean"}]})
    rows = [dict(zip("abcd", r)) for r in rows]
    got, values = avro.contents(avro.container(schema, rows, codec=codec, block_rows=block))
    assert got == schema and list(values) == rows


def test_a_type_that_holds_itself_and_bytes_that_are_none():
    tree = {"type": "record", "name": "n", "fields": [{"name": "v", "type": "int"}, {"name": "next", "type": ["null", "n"]}]}
    v = {"v": 1, "next": {"v": 2, "next": None}}
    assert back(tree, to_bytes(tree, v)) == v
    for bad in (b"", b"\x80", b"\x09ab"):
        with pytest.raises(avro.AvroError):
            back("string", bad)


def test_messages_in_frames(spark):
    text = json.dumps(ROW)
    df = spark.createDataFrame([(i, r | {"props": dict(r["props"]), "by": dict(r["by"])} if r else None) for i, r in enumerate([*ROWS, None])], f"n bigint, value {avro.spark_type(text).simpleString()}")
    sent = avro.encode(df, text, "value", schema_id=7)
    assert sent.schema["value"].dataType.simpleString() == "binary" and sent.filter("n = 0").head().value[:5] == b"\x00\x00\x00\x00\x07"
    got = {r.n: r for r in avro.decode(sent, {7: text}).collect()}
    want = {r.n: r for r in df.collect()}
    assert all(got[n]._v == want[n].value for n in want)
    wide = changelog.decode_avro(sent, text)
    assert wide.columns == ["n", *[f["name"] for f in ROW["fields"]]] and wide.filter("id is null").count() == 1


def test_messages_of_several_schemas_and_of_none(spark):
    one = json.dumps({"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "old", "type": "string"}]})
    two = json.dumps({"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "new", "type": ["null", "string"]}]})
    frame = lambda i, s, v: b"\x00" + i.to_bytes(4, "big") + to_bytes(json.loads(s), v)
    data = [frame(1, one, {"a": 1, "old": "x"}), frame(2, two, {"a": 2, "new": "y"}), frame(3, one, {"a": 3, "old": "z"}), b"", b"\x01abc", None]
    got = avro.decode(spark.createDataFrame([(i, d) for i, d in enumerate(data)], "n bigint, value binary"), {1: one, 2: two}).orderBy("n").collect()
    assert [r._v and tuple(r._v) for r in got] == [(1, None), (2, "y"), None, None, None, None]


def test_reading_container_files(spark, tmp_path, rows):
    schema = json.dumps({"type": "record", "name": "r", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": ["null", "string"]}]})
    for i in range(2):
        (tmp_path / f"{i}.avro").write_bytes(avro.container(schema, [{"a": i * 10 + k, "b": None if k else "s"} for k in range(3)]))
    assert rows(avro.read_files(spark, str(tmp_path), schema)) == sorted([(i * 10 + k, None if k else "s") for i in range(2) for k in range(3)], key=repr)
