"""Time columns: precisions, epochs, durations."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of a second by precision.
PER_SECOND = {"MILLIS": 10**3, "MICROS": 10**6, "NANOS": 10**9}
#: Units of a duration in order, with their names and nanoseconds.
UNITS = [
    ("h", r"h(?:ours?)?", 3600 * 10**9), ("m", r"m(?:in(?:ute)?s?)?", 60 * 10**9), ("s", r"s(?:ec(?:ond)?s?)?", 10**9),
    ("ms", r"(?:ms|milli(?:s|seconds?)?)", 10**6), ("us", r"(?:us|micro(?:s|seconds?)?)", 10**3), ("ns", r"(?:ns|nano(?:s|seconds?)?)", 1),
]
_DURATION = r"(?i)^\s*" + "".join(rf"(?:(\d+)\s*{names}(?![a-z])\s*|)" if unit not in ("h", "m", "s") else rf"(?:(\d+)\s*{names}(?![a-z]+)\s*|)" for unit, names, _ in UNITS) + r"$"


def convert(x: Column, source: str, target: str) -> Column:
    """From one precision to another, rounding down: -1 ns is in the microsecond -1, not 0."""
    a, b = PER_SECOND[source], PER_SECOND[target]
    if b >= a:
        return x * F.lit(b // a).cast("bigint")
    k = F.lit(a // b).cast("bigint")
    return F.call_function("div", x - F.pmod(x, k), k)


def duration_nanos(text: Column) -> Column:
    """Nanoseconds of a duration such as '1 hour 200 minutes' or '2h3m4s5ms6us7ns': units in this order, in any case; null for anything else."""
    total = F.lit(0).cast("bigint")
    for i, (_, _, nanos) in enumerate(UNITS):
        part = F.regexp_extract(text, _DURATION, i + 1)
        total = total + F.coalesce(F.nullif(part, F.lit("")).try_cast("bigint"), F.lit(0)) * F.lit(nanos).cast("bigint")
    return F.when(text.rlike(_DURATION) & text.rlike(r"\d"), total)


def duration_text(nanos: Column) -> Column:
    """The shortest such text, '0s' for nothing."""
    parts, rest = [], nanos
    for unit, _, size in UNITS:
        n = F.call_function("div", rest, F.lit(size).cast("bigint"))
        parts.append(F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))))
        rest = rest - n * F.lit(size).cast("bigint")
    return F.when(nanos == 0, F.lit("0s")).when(nanos.isNotNull(), F.concat_ws("", *parts))


def parse_duration(text: str) -> float:
    """Seconds of such a text, for configuration."""
    m = re.match(_DURATION, text)
    if not m or not re.search(r"\d", text):
        raise ValueError(f"no duration: {text!r}")
    return sum(int(n) * size for n, (_, _, size) in zip(m.groups(), UNITS) if n) / 1e9


def source_day(ts_ms: Column, offset_minutes: int = 0) -> Column:
    """The day of epoch milliseconds at a fixed offset from UTC."""
    day = F.lit(86_400_000)
    t = ts_ms + F.lit(offset_minutes * 60_000).cast("bigint")
    return F.date_from_unix_date(F.floor(t / day).cast("int"))
