import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.schema import derive, evolve

S = T.StructType.fromDDL


def changes(old, new):
    with_ids, last = evolve.assign_ids(S(old), 0)
    schema, found, _ = evolve.migrate(with_ids, S(new), last)
    return schema, {(c.kind, c.path) for c in found}


@pytest.mark.parametrize(
    "old,new,want",
    [
        ("a int, dropping int", "a int", {("drop", "dropping")}),
        ("a int", "a int, adding string", {("add", "adding")}),
        ("a int, b float, c boolean, d decimal(10,3)", "a string, b boolean, c float, d decimal(10,7)", {("replace", x) for x in "abcd"}),
        ("a int, b float, c decimal(10,3)", "a bigint, b double, c decimal(20,3)", {("promote", x) for x in "abc"}),
        ("a bigint, b double, c decimal(20,3)", "a int, b float, c decimal(10,3)", {("replace", x) for x in "abc"}),
        ("a int, b int", "b int, a int", set()),
        ("a int not null", "a int", {("nullability", "a")}),
        ("l array<string>, m map<string,int>", "l array<int>, m map<int,int>", {("replace", "l"), ("replace", "m")}),
        ("l array<decimal(10,3)>, m map<string,int>", "l array<decimal(20,3)>, m map<string,bigint>", {("promote", "l.element"), ("promote", "m.value")}),
        ("l array<map<string,int>>", "l array<struct<a:int>>", {("replace", "l")}),
        ("l array<struct<a:int,b:int,c:int>>", "l array<struct<a:bigint,c:string,d:int>>", {("promote", "l.element.a"), ("drop", "l.element.b"), ("replace", "l.element.c"), ("add", "l.element.d")}),
        ("s struct<x:struct<y:int>>", "s struct<x:struct<y:bigint,z:int>>", {("promote", "s.x.y"), ("add", "s.x.z")}),
        ("s struct<a:int>", "s int", {("replace", "s")}),
    ],
)
def test_migrations(old, new, want):
    schema, found = changes(old, new)
    assert found == want and sorted(schema.names) == sorted(S(new).names)
    assert evolve.equal(schema, S(new))


def test_ids_are_kept_and_never_used_again():
    old, last = evolve.assign_ids(S("a int, b string, s struct<x:int>"), 0)
    assert [f.metadata["field_id"] for f in old.fields] == [1, 2, 3] and last == 4
    mid, _, last = evolve.migrate(old, S("a bigint, s struct<x:int,y:int>"), last)
    new, _, last = evolve.migrate(mid, S("a bigint, b string, s struct<x:int,y:int>"), last)
    assert new["a"].metadata["field_id"] == 1 and new["b"].metadata["field_id"] == 6 and last == 6
    assert evolve.physical(new).simpleString() == "struct<c1:bigint,c3:struct<c4:int,c5:int>,c6:string>"


def test_doc_and_nullability_of_elements():
    a = T.StructType([T.StructField("l", T.ArrayType(T.IntegerType(), False), True, {"comment": "x"})])
    b = T.StructType([T.StructField("l", T.ArrayType(T.IntegerType(), True), True, {"comment": "y"})])
    old, last = evolve.assign_ids(a, 0)
    schema, found, _ = evolve.migrate(old, b, last)
    assert {(c.kind, c.path) for c in found} == {("doc", "l"), ("nullability", "l.element")} and schema["l"].metadata["comment"] == "y"


@pytest.mark.parametrize("stored,version,key,value,want", [(None, "v1", True, True, True), ("v1", "v1", True, True, False), ("v1", "v2", True, True, True), ("v1", "v2", True, False, False), ("v1", "v2", False, True, False)])
def test_when_to_migrate(stored, version, key, value, want):
    assert evolve.should_migrate(stored, version, key, value) is want


KEY = {"type": "struct", "fields": [{"field": "id", "type": "int32", "optional": True}]}


def row(*fields):
    return {"type": "struct", "fields": [{"field": "after", "type": "struct", "optional": True, "fields": list(fields)}, {"field": "op", "type": "string"}]}


def test_tables_from_messages():
    f = lambda n, t, **k: {"field": n, "type": t, "optional": True, **k}
    value = row(
        f("id", "int16"), f("f", "float32"), f("b", "bytes"), f("at", "int64", name="io.debezium.time.MicroTimestamp"), f("n", "bytes", name="org.apache.kafka.connect.data.Decimal", parameters={"scale": "3", "connect.decimal.precision": "19"}),
        f("l", "array", items={"type": "string", "optional": False}), f("m", "map", keys={"type": "string"}, values={"type": "int64", "optional": True}), f("s", "struct", fields=[f("x", "int8", doc="an x")]), f("e", "string", name="io.debezium.data.Enum"),
        f("unknown", "string", name="io.debezium.data.Json"),
    )
    schema, keys = derive.table_schema(KEY, value)
    assert keys == ["id"] and not schema["id"].nullable
    assert schema.simpleString() == "struct<id:int,f:float,b:binary,at:timestamp_ntz,n:decimal(19,3),l:array<string>,m:map<string,bigint>,s:struct<x:int>,e:string,unknown:string>"
    assert not schema["l"].dataType.containsNull and schema["m"].dataType.valueContainsNull and schema["s"].dataType["x"].metadata["comment"] == "an x"
    for bad_key in ({"type": "struct", "fields": []}, {"type": "struct", "fields": [{"field": "other", "type": "int32"}]}):
        with pytest.raises(ValueError):
            derive.table_schema(bad_key, value)
    with pytest.raises(ValueError):
        derive.table_type({"type": "odd"})


def test_there_and_back():
    s = S("a int not null, b bigint, c float, d double, e boolean, f string, g binary, h date, i timestamp_ntz, j decimal(12,4), k array<struct<x:int>>, l map<string,double>")
    assert evolve.equal(derive.table_type(derive.message_schema(s)), s)


def test_values_convert_at_any_depth(spark):
    micro = {"type": "int64", "name": "io.debezium.time.MicroTime"}
    milli = {"type": "int32", "name": "io.debezium.time.Time"}
    schema = {"type": "struct", "fields": [{"field": "l", "type": "array", "items": milli}, {"field": "m", "type": "map", "keys": {"type": "string"}, "values": micro}, {"field": "s", "type": "struct", "fields": [{"field": "t", **milli}]}]}
    df = spark.createDataFrame([(([1, None], {"a": 5}, (7,)),), (None,)], "r struct<l:array<int>,m:map<string,bigint>,s:struct<t:int>>")
    got = df.select(derive.convert(F.col("r"), schema).alias("r")).collect()
    assert got[0].r.l == [1000, None] and got[0].r.m == {"a": 5} and got[0].r.s.t == 7000 and got[1].r is None
