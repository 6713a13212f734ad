"""Logical types of a change stream: name -> table type and conversion, in a registry that callers can extend."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .time import convert


@dataclass(frozen=True)
class Logical:
    """Table type and conversion of a logical type; a function of the schema's parameters gives the type where it depends on them."""

    type: T.DataType | Callable[[dict], T.DataType]
    convert: Callable[[Column], Column]

    def table_type(self, params: dict | None = None) -> T.DataType:
        return self.type(params or {}) if callable(self.type) and not isinstance(self.type, T.DataType) else self.type


def _ntz(us: Column) -> Column:
    """Timestamp without zone of microseconds, whatever the session's zone."""
    return F.call_function("make_timestamp_ntz", *_parts(us))


def _parts(us: Column) -> list[Column]:
    day, rest = F.floor(us / F.lit(86_400_000_000)), F.pmod(us, F.lit(86_400_000_000))
    date = F.date_from_unix_date(day.cast("int"))
    second = (F.pmod(rest, F.lit(60_000_000)) / F.lit(1_000_000)).cast("decimal(16,6)")
    whole = lambda c, k: F.call_function("div", c, F.lit(k).cast("bigint")).cast("int")
    return [F.year(date), F.month(date), F.day(date), whole(rest, 3_600_000_000), whole(F.pmod(rest, F.lit(3_600_000_000)), 60_000_000), second]


def decimal_type(params: dict) -> T.DataType:
    """Precision 38 and scale 10 unless the schema says otherwise."""
    return T.DecimalType(int(params.get("connect.decimal.precision", 38)), int(params.get("scale", 10)))


def variable_scale_decimal(scale: Column, value: Column) -> Column:
    """A big-endian two's-complement number of any length times 10^-scale, rounded half up to 18 places; null if that is more than decimal(38, 18) holds.

    The bytes are read as two limbs of 16 hexadecimal digits from the right, all in the JVM; digits before them have to be
    nothing but sign.
    """
    two64 = F.lit("18446744073709551616").cast("decimal(38,0)")

    def number(digits: Column) -> Column:
        sign = F.when(F.substring(digits, 1, 1) >= "8", "F").otherwise("0")
        wide = F.lpad(F.substring(digits, -32, 32), 32, sign)
        high, low = (F.conv(F.substring(wide, at, 16), 16, 10).cast("decimal(38,0)") for at in (1, 17))
        n = F.try_add(F.try_multiply(F.when(sign == "F", high - two64).otherwise(high), two64), low)
        more = F.length(digits) - 32
        return F.when((more <= 0) | (F.trim(digits.substr(F.lit(1), F.greatest(more, F.lit(0))), sign) == ""), n)

    def shifted(plain: Column) -> Column:
        # moving the decimal point of the text keeps every digit
        whole = F.lpad(plain, F.greatest(F.length(plain), scale + 1), "0")
        point = F.length(whole) - scale
        return F.when(scale <= 0, F.concat(plain, F.repeat(F.lit("0"), -scale))).otherwise(F.concat(F.left(whole, point), F.lit("."), F.right(whole, scale)))

    def text(n: Column) -> Column:
        return F.concat(F.when(n < 0, "-").otherwise(""), _once(F.replace(n.cast("string"), F.lit("-"), F.lit("")), shifted))

    return _once(F.hex(value), lambda digits: _once(number(digits), text)).try_cast("decimal(38,18)")


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def zoned_micros(text: Column) -> Column:
    """Microseconds UTC of an ISO text with zone; infinity and -infinity are the largest and smallest number, on every path."""
    t = F.unix_micros(F.call_function("try_to_timestamp", text))
    return F.when(text == "infinity", F.lit(2**63 - 1)).when(text == "-infinity", F.lit(-(2**63))).otherwise(t)


def zoned_time(text: Column) -> Column:
    """Microseconds of the day of an ISO time in UTC; null for other zones."""
    p = r"^(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(?:Z|\+00:?00)$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, p, i), F.lit("")).try_cast("bigint"), F.lit(0))
    frac = F.rpad(F.regexp_extract(text, p, 4), 6, "0").try_cast("bigint")
    return F.when(text.rlike(p), part(1) * F.lit(3_600_000_000) + part(2) * F.lit(60_000_000).cast("bigint") + part(3) * F.lit(1_000_000).cast("bigint") + frac)


def enum_set(text: Column) -> Column:
    """The members of a comma-separated set; none for an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def _same(c: Column) -> Column:
    return c


_TIME, _NTZ, _DATE = T.LongType(), T.TimestampNTZType(), T.DateType()

# The names are those of the message formats.
#: Logical name -> type. Times of day are microseconds in a bigint, for the time type is off by default.
REGISTRY: dict[str, Logical] = {
    "org.apache.kafka.connect.data.Decimal": Logical(decimal_type, _same),
    "org.apache.kafka.connect.data.Date": Logical(_DATE, lambda c: F.date_from_unix_date(c.cast("int"))),
    "org.apache.kafka.connect.data.Time": Logical(_TIME, lambda c: convert(c, "MILLIS", "MICROS")),
    "org.apache.kafka.connect.data.Timestamp": Logical(_NTZ, lambda c: _ntz(convert(c, "MILLIS", "MICROS"))),
    "io.debezium.time.Date": Logical(_DATE, lambda c: F.date_from_unix_date(c.cast("int"))),
    "io.debezium.time.Time": Logical(_TIME, lambda c: convert(c.cast("bigint"), "MILLIS", "MICROS")),
    "io.debezium.time.MicroTime": Logical(_TIME, _same),
    "io.debezium.time.NanoTime": Logical(_TIME, lambda c: convert(c, "NANOS", "MICROS")),
    "io.debezium.time.ZonedTime": Logical(_TIME, zoned_time),
    "io.debezium.time.Timestamp": Logical(_NTZ, lambda c: _ntz(convert(c, "MILLIS", "MICROS"))),
    "io.debezium.time.MicroTimestamp": Logical(_NTZ, _ntz),
    "io.debezium.time.NanoTimestamp": Logical(_NTZ, lambda c: _ntz(convert(c, "NANOS", "MICROS"))),
    "io.debezium.time.ZonedTimestamp": Logical(T.TimestampType(), lambda c: F.timestamp_micros(zoned_micros(c))),
    "io.debezium.time.Year": Logical(T.IntegerType(), _same),
    "io.debezium.data.VariableScaleDecimal": Logical(T.DecimalType(38, 18), lambda c: variable_scale_decimal(c["scale"], c["value"])),
    "io.debezium.data.Enum": Logical(T.StringType(), _same),
    "io.debezium.data.EnumSet": Logical(T.StringType(), _same),
}
#: Types that a table may ask for instead of the default.
OPTIONAL: dict[str, Logical] = {
    "io.debezium.data.EnumSet": Logical(T.ArrayType(T.StringType()), enum_set),
    "io.debezium.data.geometry.Geometry": Logical(T.StructType([T.StructField("wkb", T.BinaryType(), False), T.StructField("srid", T.IntegerType())]), _same),
}


def register(name: str, logical: Logical) -> None:
    """Add or replace a logical type."""
    REGISTRY[name] = logical


def convert_column(c: Column, name: str | None) -> Column:
    """The column in its table type; types without an entry stay as they are."""
    return REGISTRY[name].convert(c) if name in REGISTRY else c
