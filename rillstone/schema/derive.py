"""Table schemas from the schemas that messages carry, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.logical import REGISTRY

#: Physical types of messages; small integers are widened.
PHYSICAL: dict[str, T.DataType] = {
    "int8": T.IntegerType(), "int16": T.IntegerType(), "int32": T.IntegerType(), "int64": T.LongType(), "float": T.FloatType(), "float32": T.FloatType(), "double": T.DoubleType(), "float64": T.DoubleType(),
    "boolean": T.BooleanType(), "string": T.StringType(), "bytes": T.BinaryType(),
}


def table_type(schema: dict) -> T.DataType:
    """Type of a message schema in its JSON form (type, optional, name, parameters, fields, items, keys, values)."""
    if schema.get("name") in REGISTRY:
        return REGISTRY[schema["name"]].table_type(schema.get("parameters"))
    kind = schema["type"]
    if kind == "struct":
        return T.StructType([_field(f) for f in schema["fields"]])
    if kind == "array":
        return T.ArrayType(table_type(schema["items"]), schema["items"].get("optional", False))
    if kind == "map":
        return T.MapType(table_type(schema["keys"]), table_type(schema["values"]), schema["values"].get("optional", False))
    if kind not in PHYSICAL:
        raise ValueError(f"unknown type {kind!r}")
    return PHYSICAL[kind]


def _field(f: dict) -> T.StructField:
    meta = {"comment": f["doc"]} if f.get("doc") else {}
    return T.StructField(f["field"], table_type(f), f.get("optional", False), meta)


def table_schema(key: dict, value: dict) -> tuple[T.StructType, list[str]]:
    """Row schema (that of ``after``, or the whole value if there is none) and identifier fields of a topic's messages. Identifier fields are required; a key without fields is an error, for changes could not be told apart."""
    after = next((f for f in value.get("fields", []) if f.get("field") == "after"), None)
    row = table_type(after or value)
    keys = [f["field"] for f in key.get("fields", [])]
    if not keys:
        raise ValueError("a table needs identifier fields, the message key has none")
    missing = [k for k in keys if k not in row.names]
    if missing:
        raise ValueError(f"identifier fields that the row lacks: {missing}")
    return T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name not in keys, f.metadata) for f in row.fields]), keys


def convert(c: Column, schema: dict) -> Column:
    """A message column in its table type, at any depth."""
    if schema.get("name") in REGISTRY:
        return REGISTRY[schema["name"]].convert(c)
    kind = schema["type"]
    if kind == "struct":
        return F.when(c.isNotNull(), F.struct(*[convert(c[f["field"]], f).alias(f["field"]) for f in schema["fields"]]))
    if kind == "array":
        return F.transform(c, lambda x: convert(x, schema["items"]))
    if kind == "map":
        return F.transform_values(c, lambda _, v: convert(v, schema["values"]))
    return c.cast(PHYSICAL[kind])


def message_schema(t: T.DataType, nullable: bool = True, name: str | None = None, doc: str | None = None) -> dict:
    """The message schema of a table type."""
    logical = {T.DateType: ("int32", "org.apache.kafka.connect.data.Date"), T.TimestampNTZType: ("int64", "org.apache.kafka.connect.data.Timestamp"), T.TimestampType: ("int64", "org.apache.kafka.connect.data.Timestamp")}
    plain = {T.ByteType: "int32", T.ShortType: "int32", T.IntegerType: "int32", T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64", T.BooleanType: "boolean", T.StringType: "string", T.BinaryType: "bytes"}
    out: dict = {"optional": nullable}
    if name:
        out["field"] = name
    if doc:
        out["doc"] = doc
    if isinstance(t, T.StructType):
        return out | {"type": "struct", "fields": [message_schema(f.dataType, f.nullable, f.name, f.metadata.get("comment")) for f in t.fields]}
    if isinstance(t, T.ArrayType):
        return out | {"type": "array", "items": message_schema(t.elementType, t.containsNull)}
    if isinstance(t, T.MapType):
        return out | {"type": "map", "keys": message_schema(t.keyType, False), "values": message_schema(t.valueType, t.valueContainsNull)}
    if isinstance(t, T.DecimalType):
        return out | {"type": "bytes", "name": "org.apache.kafka.connect.data.Decimal", "parameters": {"scale": str(t.scale), "connect.decimal.precision": str(t.precision)}}
    if type(t) in logical:
        kind, full = logical[type(t)]
        return out | {"type": kind, "name": full}
    return out | {"type": plain[type(t)]}
