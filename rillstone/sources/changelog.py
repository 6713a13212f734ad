"""Change logs: the envelope, decoding, offsets and lag, and a log derived from an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import time
from ..session import micros
from . import avro

SOURCE = T.StructType([T.StructField("ts_ms", T.LongType()), T.StructField("file", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("lsn", T.LongType())])


def envelope(row: T.StructType, key: T.StructType) -> T.StructType:
    """The schema every consumer of a change log of rows ``row`` sees."""
    f = T.StructField
    return T.StructType(
        [
            f("topic", T.StringType()), f("kafka_partition", T.IntegerType()), f("kafka_offset", T.LongType()), f("kafka_ts", T.TimestampType()), f("schema_version", T.StringType()),
            f("key", key), f("op", T.StringType()), f("before", row), f("after", row), f("source", SOURCE), f("ts_ms", T.LongType()),
        ]
    )


def decode_json(raw: DataFrame, row: T.StructType, key: T.StructType, *, key_col: str = "key", value_col: str = "value") -> DataFrame:
    """Messages with JSON key and value as envelopes; a null value is a tombstone and keeps its place. Unreadable JSON gives nulls, as a tombstone would."""
    value = T.StructType([T.StructField("op", T.StringType()), T.StructField("before", row), T.StructField("after", row), T.StructField("source", SOURCE), T.StructField("ts_ms", T.LongType())])
    rest = [c for c in raw.columns if c not in (key_col, value_col)]
    v = F.from_json(F.col(value_col).cast("string"), value)
    return raw.select(*rest, F.from_json(F.col(key_col).cast("string"), key).alias("key"), v.alias("_v")).select(*rest, "key", "_v.*")


def decode_avro(raw: DataFrame, schema: str | dict[int, str], *, value_col: str = "value", framed: bool = True) -> DataFrame:
    """Messages with an Avro value as columns of its record (see :func:`avro.decode`); ``framed`` values begin with a magic byte and a four-byte schema id, by which ``schema`` may name several."""
    rest = [c for c in raw.columns if c != value_col]
    return avro.decode(raw, schema, value_col=value_col, framed=framed).select(*rest, "_v.*")


#: Decoders by name, for ``key.converter`` and ``value.converter``; callers may add theirs.
CONVERTERS = {"json": decode_json, "avro": decode_avro}


def converter(config: dict[str, str], which: str):
    """The decoder that a configuration names for ``key`` or ``value``, and the options under its prefix."""
    name = config.get(f"{which}.converter", "json")
    prefix = f"{which}.converter."
    found = CONVERTERS.get(name) or next((f for k, f in CONVERTERS.items() if name.rpartition(".")[2].lower().startswith(k)), None)
    if found is None:
        raise ValueError(f"unknown converter {name!r}")
    return found, {k.removeprefix(prefix): v for k, v in config.items() if k.startswith(prefix)}


def schema_version(key_version, value_version):
    """The text that identifies the schemas of a message."""
    return F.format_string("key=%s,value=%s", key_version, value_version)


def next_offsets(log: DataFrame, partition: str = "kafka_partition", offset: str = "kafka_offset") -> DataFrame:
    """Per partition the offset after the last."""
    return log.groupBy(F.col(partition).alias("part")).agg((F.max(offset) + 1).alias("next"))


def lag(latest: DataFrame, committed: DataFrame) -> DataFrame:
    """Per partition how far the committed offset is behind; a partition without commit is behind by all of it."""
    c = committed.select(F.col("part").alias("_p"), F.col("next").alias("_n"))
    return latest.join(c, F.col("part") == F.col("_p"), "left").select("part", F.col("next").alias("latest"), F.coalesce("_n", F.lit(0)).alias("committed"), (F.col("next") - F.coalesce("_n", F.lit(0))).alias("lag"))


def resume_offsets(table: DataFrame, broker: DataFrame) -> DataFrame:
    """Where to read on: the table's offsets win over the broker's, for they were stored with the data."""
    t = table.select("part", F.col("next").alias("_t"))
    return t.join(broker, "part", "full").select("part", F.coalesce("_t", "next").alias("next"), (F.col("_t").isNotNull() & ~F.col("_t").eqNullSafe(F.col("next"))).alias("seeks"))


def unread(log: DataFrame, offsets: DataFrame) -> DataFrame:
    """Records at or after the offsets; partitions without offset are read whole."""
    o = offsets.select(F.col("part").alias("_p"), F.col("next").alias("_n"))
    return log.join(o, F.col("kafka_partition") == F.col("_p"), "left").filter("_n is null or kafka_offset >= _n").drop("_p", "_n")


def from_events(events: DataFrame, partitions: int = 4) -> DataFrame:
    """A well-formed log of rows keyed by user: an error deletes the user's row, the first event after that creates it, others update it.

    Columns: lsn, seq, id, ts_ms, dt, v, pv (the value before), op, kafka_partition, kafka_offset.
    """
    w = Window.partitionBy("user_id").orderBy("event_id")
    p = events.select("event_id", "user_id", "ts", time.convert(micros(events, "ts"), "MICROS", "MILLIS").alias("ts_ms"), F.to_date("ts").alias("dt"), "value", "event_type", F.lag("event_type").over(w).alias("pt"), F.lag("value").over(w).alias("pv"))
    p = p.filter(~((F.col("event_type") == "error") & (F.col("pt").isNull() | (F.col("pt") == "error"))))
    op = F.when(F.col("event_type") == "error", "d").when(F.col("pt").isNull() | (F.col("pt") == "error"), "c").otherwise("u")
    log = p.select((F.col("event_id") + 1).alias("lsn"), F.col("event_id").alias("seq"), F.col("user_id").alias("id"), "ts_ms", "dt", F.col("value").alias("v"), F.col("pv"), op.alias("op"), F.pmod("user_id", F.lit(partitions)).cast("int").alias("kafka_partition"))
    return log.withColumn("kafka_offset", F.row_number().over(Window.partitionBy("kafka_partition").orderBy("seq")).cast("bigint") - 1)
