"""The change feed as messages: identifiers and source positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import micros

#: Identifier of a message, see :func:`messages`.
IDENT = ["src_name", "src_table", "file_no", "pos", "row_no", "lsn", "entity_id"]


def file_number(file: Column) -> Column:
    """The number after the last dot of a log file's name, null if there is none: mysql-bin.999999 comes before binlog.1000000."""
    return F.regexp_extract(file, r"\.(\d+)$", 1).try_cast("bigint")


def key_number(key: Column, names: list[str]) -> Column:
    """The id in a JSON key as a number, however it is spelled; null if no name is there or it is no number."""
    got = F.from_json(key, ", ".join(f"`{n}` string" for n in names))
    return F.coalesce(*[got[n].try_cast("decimal(38,6)").try_cast("bigint") for n in names])


def messages(feed: DataFrame, ids: list[str] | None = None, *more: str) -> DataFrame:
    """Rows of the feed with a source and a record key (no tombstones, no transaction marks), with identifier and position.

    Columns: delivery_id, arrived_us, topic, op, after, file_id, those of ``IDENT`` and ``more`` of the feed's own.
    """
    names = ids or ["actor_id", "film_id"]
    rows = feed.filter(F.col("source").isNotNull() & F.col("record_key").isNotNull())
    return rows.select(
        "delivery_id", micros(feed, "arrived_at").alias("arrived_us"), "topic", "op", "after", "file_id",
        F.col("source.name").alias("src_name"), F.col("source.table").alias("src_table"), file_number(F.col("source.file")).alias("file_no"),
        F.col("source.pos").alias("pos"), F.col("source.row").cast("bigint").alias("row_no"), F.col("source.lsn").alias("lsn"), key_number(F.col("record_key"), names).alias("entity_id"), *more,
    )
