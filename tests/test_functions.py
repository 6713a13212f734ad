import random
import struct
from datetime import datetime
from decimal import ROUND_HALF_UP, Context, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillstone.functions import logical, time, transforms, wal


def one(spark, rows, ddl, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*cols).collect()]


def test_precisions_round_down(spark):
    got = one(spark, [(x,) for x in (-1, 0, 999, -1000, -1001, None)], "x bigint", time.convert(F.col("x"), "NANOS", "MICROS"), time.convert(F.col("x"), "MILLIS", "NANOS"))
    assert got == [(-1, -1_000_000), (0, 0), (0, 999_000_000), (-1, -1_000_000_000), (-2, -1_001_000_000), (None, None)]


DURATIONS = {"1 hour 200 minutes": 15600.0, "3600 secs": 3600.0, "2h3m4s5ms6us7ns": 7384.005006007, "10m": 600.0, "90 S": 90.0, "5 millis": 0.005, "1 min": 60.0}


def test_durations(spark):
    names = [*DURATIONS, "1 day", "", "5", "2m1h", None]
    got = one(spark, [(n,) for n in names], "x string", time.duration_nanos(F.col("x")))
    assert [g[0] for g in got] == [round(v * 1e9) for v in DURATIONS.values()] + [None] * 5
    for text, s in DURATIONS.items():
        assert time.parse_duration(text) == pytest.approx(s)
    for text in ("1 day", "", "2m1h"):
        with pytest.raises(ValueError):
            time.parse_duration(text)
    shown = one(spark, [(n,) for n in (15600 * 10**9, 7384005006007, 0, 1, None)], "x bigint", time.duration_text(F.col("x")))
    assert [s[0] for s in shown] == ["4h20m", "2h3m4s5ms6us7ns", "0s", "1ns", None]


def test_source_days_at_offsets(spark):
    got = one(spark, [(0,), (-1,), (17 * 3_600_000,)], "x bigint", time.source_day(F.col("x")).cast("string"), time.source_day(F.col("x"), 420).cast("string"))
    assert got == [("1970-01-01", "1970-01-01"), ("1969-12-31", "1970-01-01"), ("1970-01-01", "1970-01-02")]


def test_positions_and_offsets(spark):
    assert wal.decode_position(wal.encode_position("mysql", {"file": 1000000, "pos": 4})) > wal.decode_position(wal.encode_position("mysql", {"file": 999999, "pos": 900}))
    assert wal.decode_position(wal.encode_position("postgresql", {"lsn": 5})) == (5,)
    got = one(spark, [({10: 5, 2: 7},), ({},)], "m map<int,bigint>", wal.offsets_json(F.col("m")), wal.offsets_map(wal.offsets_json(F.col("m"))))
    assert got == [('{"2":7,"10":5}', {2: 7, 10: 5}), ("{}", {})]
    rows = one(spark, [("a.10", 1), ("b.9", 99)], "f string, p bigint", wal.mysql_position(F.col("f"), F.col("p")).alias("x"))
    assert rows[0][0] > rows[1][0]


def test_bucket_hashes_of_the_public_specification(spark):
    assert transforms.murmur3_bytes(struct.pack("<q", 34)) == 2017239379 and transforms.murmur3_bytes(b"iceberg") == 1210000089
    xs = [34, 0, -1, 2**63 - 1, -(2**63), 20486, 1510871468000000]
    got = one(spark, [(x,) for x in xs], "x bigint", transforms.murmur3_long(F.col("x")))
    assert [g[0] for g in got] == [transforms.murmur3_bytes(struct.pack("<q", x)) for x in xs]


def test_transforms_of_all_types(spark):
    df = spark.createDataFrame([(-7, "iceberg", datetime(1969, 12, 31, 23, 30), b"\x00\x01\x02\x03"), (None, None, None, None)], "i int, s string, t timestamp_ntz, b binary")
    specs = ["i", "identity(s)", "year(t)", "months(t)", "day(t)", "hour(t)", "truncate[5](i)", "truncate[3](s)", "void(i)", "bucket[16](i)", "bucket[100](s)", "bucket[7](b)", "bucket[8](t)"]
    cols = [transforms.transform(df, s) for s in specs]
    r, nothing = (tuple(x) for x in df.select(*[c.alias(n) for n, c in cols]).collect())
    assert r[:9] == (-7, "iceberg", -1, -1, -1, -1, -10, "ice", None)
    assert r[9] == (transforms.murmur3_bytes(struct.pack("<q", -7)) & 0x7FFFFFFF) % 16 and r[10] == (1210000089 & 0x7FFFFFFF) % 100 and 0 <= r[11] < 7 and 0 <= r[12] < 8
    assert set(nothing) == {None}
    for bad in ("bucket(i)", "nope(i)", "a b c"):
        with pytest.raises(ValueError):
            transforms.transform(df, bad)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=40))
def test_hash_of_bytes_is_stable_under_copying(b):
    assert transforms.murmur3_bytes(bytes(bytearray(b))) == transforms.murmur3_bytes(b) < 2**32


def number(x):
    n = max(1, (x.bit_length() + 8) // 8)
    return x.to_bytes(n, "big", signed=True)


def test_decimals_of_variable_scale(spark):
    rng = random.Random(9)
    cases = [(0, 0), (5, 0), (-5, 0), (2, 12345), (2, -12345), (0, 2**62), (3, -(2**63)), (18, 10**18), (20, 149), (20, 150), (20, -150), (30, 10**30), (0, 2**64), (1, -(2**64) - 1), (4, 7)]
    cases += [(rng.randint(0, 20), rng.randint(-(10**20), 10**20)) for _ in range(60)]
    df = spark.createDataFrame([((s, bytearray(number(v))),) for s, v in cases] + [((2, None),), (None,)], "n struct<scale:int,value:binary>")
    got = [r[0] for r in df.select(logical.convert_column(F.col("n"), "io.debezium.data.VariableScaleDecimal")).collect()]
    ctx = Context(prec=60, rounding=ROUND_HALF_UP)
    want = [ctx.quantize(ctx.scaleb(Decimal(v), -s), Decimal(1).scaleb(-18)) for s, v in cases]
    assert got == want + [None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_times_in_any_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        conv = lambda c, n: logical.convert_column(c, n)
        df = spark.createDataFrame([(-1, "2020-03-08T02:30:00.123456+07:00", "23:59:59.5Z"), (1583634600000, "infinity", "10:00+01:00"), (None, None, None)], "x bigint, z string, t string")
        got = df.select(
            conv(F.col("x"), "io.debezium.time.Timestamp").cast("string"), conv(F.col("x"), "io.debezium.time.MicroTimestamp").cast("string"),
            logical.zoned_micros(F.col("z")), conv(F.col("t"), "io.debezium.time.ZonedTime"), conv(F.col("x"), "io.debezium.time.NanoTime"),
        ).collect()
        assert tuple(got[0]) == ("1969-12-31 23:59:59.999", "1969-12-31 23:59:59.999999", 1583609400123456, 86_399_500_000, -1)
        assert tuple(got[1])[0] == "2020-03-08 02:30:00" and got[1][2] == 2**63 - 1 and got[1][3] is None
        assert tuple(got[2]) == (None,) * 5
        from rillstone.session import micros

        t = spark.sql("select timestamp_ntz'2020-03-08 02:30:00.000001' a, timestamp_ntz'1969-12-31 23:59:59.999999' b")
        assert tuple(t.select(micros(t, "a"), micros(t, "b")).first()) == (1583634600000001, -1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_sets_and_registry(spark):
    got = one(spark, [("a,b",), ("",), (None,)], "x string", logical.enum_set(F.col("x")))
    assert [g[0] for g in got] == [["a", "b"], [], None]
    logical.register("my.Type", logical.Logical(T.StringType(), F.upper))
    assert one(spark, [("a",)], "x string", logical.convert_column(F.col("x"), "my.Type")) == [("A",)]
    logical.REGISTRY.pop("my.Type")
    assert logical.REGISTRY["org.apache.kafka.connect.data.Decimal"].table_type({"scale": "3", "connect.decimal.precision": "19"}) == T.DecimalType(19, 3)
    assert logical.REGISTRY["org.apache.kafka.connect.data.Decimal"].table_type() == T.DecimalType(38, 10)
