"""Avro without a package on the class path: messages and container files, read and written by Python workers in Arrow batches.

A schema is compiled once per worker into nested functions; bytes are read and written as Avro's specification has them:
integers as zigzag varints, texts and bytes with their length, arrays and maps in blocks, unions by the number of their
branch. Maps whose keys are no texts are arrays of records of ``key`` and ``value`` (logical type ``map``). Messages may be
framed by a magic byte and the four-byte id of their schema.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from io import BytesIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIMITIVE = {"boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType(), "null": T.NullType()}
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
MAGIC = b"Obj\x01"


class AvroError(ValueError):
    """A schema or bytes that are no Avro."""


class Names:
    """Named types of a schema, by full name."""

    def __init__(self):
        self.known: dict[str, dict] = {}

    def full(self, name: str, space: str) -> str:
        return name if "." in name or not space else f"{space}.{name}"

    def resolve(self, schema, space: str):
        """The schema with its names looked up: a primitive's name, a list for a union, or a dict; and the namespace of what it holds."""
        if isinstance(schema, str):
            if schema in PRIMITIVE:
                return schema, space
            found = self.known.get(self.full(schema, space)) or self.known.get(schema)
            if found is None:
                raise AvroError(f"unknown type {schema!r}")
            return found, found["_space"]
        if isinstance(schema, dict) and schema["type"] in ("record", "enum", "fixed", "error"):
            own = self.full(schema["name"], schema.get("namespace") or space)
            schema.setdefault("_space", own.rpartition(".")[0])
            schema.setdefault("_full", own)
            self.known[own] = schema
            return schema, schema["_space"]
        if isinstance(schema, dict) and isinstance(schema["type"], (dict, list)):
            return self.resolve(schema["type"], space)
        return schema, space


def _kind(schema) -> str:
    return schema if isinstance(schema, str) else "union" if isinstance(schema, list) else schema["type"]


def _is_map(schema) -> bool:
    return isinstance(schema, dict) and schema.get("logicalType") == "map" and _kind(schema) == "array"


def spark_type(text: str) -> T.DataType:
    """The type that values of a schema have in a frame. A union of null and one type is that type; of several, a struct of a member each."""
    names = Names()

    def of(schema, space: str) -> T.DataType:
        schema, space = names.resolve(schema, space)
        kind = _kind(schema)
        logical = schema.get("logicalType") if isinstance(schema, dict) else None
        if kind in ("bytes", "fixed") and logical == "decimal":
            return T.DecimalType(schema["precision"], schema.get("scale", 0))
        if logical == "date":
            return T.DateType()
        if logical in ("timestamp-millis", "timestamp-micros"):
            return T.TimestampType()
        if kind in PRIMITIVE:
            return PRIMITIVE[kind]
        if kind == "fixed":
            return T.BinaryType()
        if kind == "enum":
            return T.StringType()
        if kind in ("record", "error"):
            return T.StructType([T.StructField(f["name"], of(f["type"], space)) for f in schema["fields"]])
        if _is_map(schema):
            pair, inner = names.resolve(schema["items"], space)
            key, value = (next(f["type"] for f in pair["fields"] if f["name"] == n) for n in ("key", "value"))
            return T.MapType(of(key, inner), of(value, inner))
        if kind == "array":
            return T.ArrayType(of(schema["items"], space))
        if kind == "map":
            return T.MapType(T.StringType(), of(schema["values"], space))
        if kind == "union":
            rest = [s for s in schema if s != "null"]
            if len(rest) == 1:
                return of(rest[0], space)
            return T.StructType([T.StructField(f"member{i}", of(s, space)) for i, s in enumerate(rest)])
        raise AvroError(f"no type {kind!r}")

    return of(json.loads(text), "")


# reading
def _long(b: BytesIO) -> int:
    shift = n = 0
    while True:
        c = b.read(1)
        if not c:
            raise AvroError("bytes end within a number")
        n |= (c[0] & 0x7F) << shift
        if c[0] < 0x80:
            return (n >> 1) ^ -(n & 1)
        shift += 7


def _take(b: BytesIO, n: int) -> bytes:
    got = b.read(n) if n >= 0 else b""
    if len(got) != n or n < 0:
        raise AvroError("bytes end within a value")
    return got


def _blocks(b: BytesIO, item: Callable) -> Iterator:
    while n := _long(b):
        if n < 0:
            _long(b)  # the block's size, for those who skip it
        for _ in range(abs(n)):
            yield item(b)


def reader(text: str) -> Callable[[BytesIO], object]:
    """The function that reads a value of the schema, as Arrow takes it for :func:`spark_type`."""
    names = Names()
    made: dict[str, Callable] = {}

    def of(schema, space: str) -> Callable:
        schema, space = names.resolve(schema, space)
        kind = _kind(schema)
        logical = schema.get("logicalType") if isinstance(schema, dict) else None
        if kind in ("record", "error", "enum", "fixed") and schema["_full"] in made:
            return lambda b: made[schema["_full"]](b)  # also of itself
        if kind in ("record", "error", "enum", "fixed"):
            made[schema["_full"]] = None
            made[schema["_full"]] = plain(schema, kind, logical, space)
            return made[schema["_full"]]
        return plain(schema, kind, logical, space)

    def plain(schema, kind: str, logical: str | None, space: str) -> Callable:
        if kind in ("bytes", "fixed"):
            raw = (lambda b: _take(b, _long(b))) if kind == "bytes" else (lambda b, n=schema["size"]: _take(b, n))
            if logical == "decimal":
                scale = schema.get("scale", 0)
                return lambda b: Decimal(int.from_bytes(raw(b), "big", signed=True)).scaleb(-scale)
            return raw
        if kind in ("int", "long"):
            if logical == "date":
                return lambda b: date(1970, 1, 1) + timedelta(days=_long(b))
            if logical == "timestamp-millis":
                return lambda b: EPOCH + timedelta(milliseconds=_long(b))
            if logical == "timestamp-micros":
                return lambda b: EPOCH + timedelta(microseconds=_long(b))
            return _long
        if kind == "null":
            return lambda b: None
        if kind == "boolean":
            return lambda b: _take(b, 1) == b"\x01"
        if kind == "float":
            return lambda b: struct.unpack("<f", _take(b, 4))[0]
        if kind == "double":
            return lambda b: struct.unpack("<d", _take(b, 8))[0]
        if kind == "string":
            return lambda b: _take(b, _long(b)).decode()
        if kind == "enum":
            return lambda b, symbols=schema["symbols"]: symbols[_long(b)]
        if kind in ("record", "error"):
            fields = [(f["name"], of(f["type"], space)) for f in schema["fields"]]
            return lambda b: {n: f(b) for n, f in fields}
        if kind == "array":
            item = of(schema["items"], space)
            if _is_map(schema):
                return lambda b: [(x["key"], x["value"]) for x in _blocks(b, item)]
            return lambda b: list(_blocks(b, item))
        if kind == "map":
            value = of(schema["values"], space)
            return lambda b: list(_blocks(b, lambda x: (_take(x, _long(x)).decode(), value(x))))
        if kind == "union":
            branches = [of(s, space) for s in schema]
            rest = [i for i, s in enumerate(schema) if s != "null"]
            if len(rest) <= 1:
                return lambda b: branches[_long(b)](b)

            def pick(b: BytesIO):
                i = _long(b)
                return {f"member{rest.index(i)}": branches[i](b)} if i in rest else None

            return pick
        raise AvroError(f"no type {kind!r}")

    return of(json.loads(text), "")


# writing
def _put_long(n: int, out: bytearray) -> None:
    n = (n << 1) ^ (n >> 63)
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)


def _put_bytes(x: bytes, out: bytearray) -> None:
    _put_long(len(x), out)
    out += x


def writer(text: str) -> Callable[[object, bytearray], None]:
    """The function that writes a value, as Arrow gives it for :func:`spark_type`, by the schema."""
    names = Names()
    made: dict[str, Callable] = {}

    def of(schema, space: str) -> Callable:
        schema, space = names.resolve(schema, space)
        kind = _kind(schema)
        if kind in ("record", "error", "enum", "fixed"):
            full = schema["_full"]
            if full not in made:
                made[full] = None
                made[full] = plain(schema, kind, space)
            return lambda v, out: made[full](v, out)
        return plain(schema, kind, space)

    def plain(schema, kind: str, space: str) -> Callable:
        logical = schema.get("logicalType") if isinstance(schema, dict) else None
        if kind in ("bytes", "fixed"):
            size = schema["size"] if kind == "fixed" else None
            if logical == "decimal":
                scale = schema.get("scale", 0)

                def raw(v) -> bytes:
                    n = int(Decimal(v).scaleb(scale))
                    return n.to_bytes(size or (n.bit_length() // 8 + 1), "big", signed=True)
            else:
                raw = bytes

            def put(v, out: bytearray) -> None:
                x = raw(v)
                if size is None:
                    _put_bytes(x, out)
                elif len(x) == size:
                    out += x
                else:
                    raise AvroError(f"{len(x)} bytes where there are {size}")

            return put
        if kind in ("int", "long"):
            if logical == "date":
                return lambda v, out: _put_long((v - date(1970, 1, 1)).days, out)
            if logical in ("timestamp-millis", "timestamp-micros"):
                unit = timedelta(milliseconds=1) if logical.endswith("millis") else timedelta(microseconds=1)
                return lambda v, out: _put_long(((v if v.tzinfo else v.replace(tzinfo=timezone.utc)) - EPOCH) // unit, out)
            return lambda v, out: _put_long(int(v), out)
        if kind == "null":
            return lambda v, out: None
        if kind == "boolean":
            return lambda v, out: out.append(1 if v else 0)
        if kind in ("float", "double"):
            form = "<f" if kind == "float" else "<d"
            return lambda v, out: out.extend(struct.pack(form, v))
        if kind == "string":
            return lambda v, out: _put_bytes(v.encode(), out)
        if kind == "enum":
            at = {s: i for i, s in enumerate(schema["symbols"])}
            return lambda v, out: _put_long(at[v], out)
        if kind in ("record", "error"):
            fields = [(f["name"], of(f["type"], space)) for f in schema["fields"]]

            def record(v, out: bytearray) -> None:
                for n, f in fields:
                    f(v[n], out)

            return record
        if kind in ("array", "map"):
            if kind == "map":
                value = of(schema["values"], space)

                def item(x, out: bytearray) -> None:
                    _put_bytes(x[0].encode(), out)
                    value(x[1], out)
            else:
                own = of(schema["items"], space)
                item = (lambda x, out: own({"key": x[0], "value": x[1]}, out)) if _is_map(schema) else own

            def many(v, out: bytearray) -> None:
                v = list(v.items()) if isinstance(v, dict) else v
                if len(v):
                    _put_long(len(v), out)
                    for x in v:
                        item(x, out)
                out.append(0)

            return many
        if kind == "union":
            branches = [of(s, space) for s in schema]
            rest = [i for i, s in enumerate(schema) if s != "null"]
            null = next((i for i, s in enumerate(schema) if s == "null"), None)

            def union(v, out: bytearray) -> None:
                if len(rest) > 1 and v is not None:
                    at, v = next(((i, v[f"member{k}"]) for k, i in enumerate(rest) if v.get(f"member{k}") is not None), (null, None))
                else:
                    at = null if v is None else rest[0]
                if at is None:
                    raise AvroError("null where there is none")
                _put_long(at, out)
                branches[at](v, out)

            return union
        raise AvroError(f"no type {kind!r}")

    return of(json.loads(text), "")


# frames
def _arrow(t: T.DataType):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


def decode(raw: DataFrame, schemas: str | dict[int, str], *, value_col: str = "value", framed: bool = True) -> DataFrame:
    """``raw`` with ``value_col`` replaced by ``_v``, its value; null for null and for bytes that are no value of the schema.

    ``schemas``: the schema of all messages, or of each id. Every message is read by its own schema and comes out in the
    type of the one with the highest id: fields it has not are left out, those it lacks are null.
    """
    by_id = {None: schemas} if isinstance(schemas, str) else dict(schemas)
    wanted = spark_type(by_id[max(by_id, key=lambda i: i or 0)])
    rest = [c for c in raw.columns if c != value_col]

    def run(batches):
        import pyarrow as pa

        readers = {i: reader(s) for i, s in by_id.items()}
        target = _arrow(wanted)
        for batch in batches:
            out = []
            for x in batch.column(value_col).to_pylist():
                try:
                    if x is None:
                        out.append(None)
                        continue
                    b = BytesIO(x)
                    number = None
                    if framed:
                        if _take(b, 1) != b"\x00":
                            raise AvroError("no magic byte")
                        number = int.from_bytes(_take(b, 4), "big")
                    out.append((readers.get(number) or readers[None])(b))
                except (AvroError, KeyError, IndexError, UnicodeDecodeError):
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(out, target)], names=[*rest, "_v"])

    return raw.select(*rest, value_col).mapInArrow(run, T.StructType([*[raw.schema[c] for c in rest], T.StructField("_v", wanted)]))


def encode(df: DataFrame, schema: str, value: str, *, schema_id: int | None = None) -> DataFrame:
    """``df`` with the struct column ``value`` as Avro bytes, framed if ``schema_id`` is given; null stays null."""
    rest = [c for c in df.columns if c != value]

    def run(batches):
        import pyarrow as pa

        put = writer(schema)
        head = b"" if schema_id is None else b"\x00" + schema_id.to_bytes(4, "big")
        for batch in batches:
            out = []
            for x in batch.column(value).to_pylist():
                own = bytearray(head)
                if x is not None:
                    put(x, own)
                out.append(None if x is None else bytes(own))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(out, pa.binary())], names=[*rest, value])

    return df.select(*rest, value).mapInArrow(run, T.StructType([*[df.schema[c] for c in rest], T.StructField(value, T.BinaryType())]))


# container files
def container(schema: str, rows: list, *, codec: str = "deflate", block_rows: int = 4096, sync: bytes | None = None) -> bytes:
    """A container file of values."""
    sync = sync or os.urandom(16)
    put, out = writer(schema), bytearray(MAGIC)
    writer('{"type": "map", "values": "bytes"}')({"avro.schema": schema.encode(), "avro.codec": codec.encode()}, out)
    out += sync
    for i in range(0, len(rows), block_rows):
        part, block = rows[i : i + block_rows], bytearray()
        for r in part:
            put(r, block)
        data = bytes(block) if codec == "null" else zlib.compress(bytes(block), wbits=-15)
        _put_long(len(part), out)
        _put_bytes(data, out)
        out += sync
    return bytes(out)


def contents(data: bytes) -> tuple[str, Iterator]:
    """Schema and values of a container file."""
    b = BytesIO(data)
    if _take(b, 4) != MAGIC:
        raise AvroError("no container file")
    meta = dict(reader('{"type": "map", "values": "bytes"}')(b))
    schema, codec, sync = meta["avro.schema"].decode(), meta.get("avro.codec", b"null").decode(), _take(b, 16)
    if codec not in ("null", "deflate"):
        raise AvroError(f"codec {codec!r}")

    def values() -> Iterator:
        read = reader(schema)
        while b.tell() < len(data):
            n, block = _long(b), _take(b, _long(b))
            own = BytesIO(block if codec == "null" else zlib.decompress(block, wbits=-15))
            for _ in range(n):
                yield read(own)
            if _take(b, 16) != sync:
                raise AvroError("a block doesn't end with the file's mark")

    return schema, values()


def read_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of container files whose records have the schema's fields, a file per task."""
    wanted = spark_type(schema)

    def run(batches):
        import pyarrow as pa

        target = _arrow(wanted)
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = list(contents(data)[1])
                for i in range(0, len(rows), 10_000):
                    got = pa.array(rows[i : i + 10_000], target)
                    yield pa.RecordBatch.from_arrays(got.flatten(), names=[f.name for f in wanted.fields])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.avro").load(path).select("content").mapInArrow(run, wanted)
