"""Positions in a source's log, and the summaries that carry them."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_index(file: Column) -> Column:
    """The number after the last dot of a binlog file's name; null if there is none."""
    return F.regexp_extract(file, r"\.(\d+)$", 1).try_cast("bigint")


def mysql_position(file: Column, pos: Column) -> Column:
    """A position that compares as the log runs: first the file's number, then the place in it."""
    return F.struct(file_index(file).alias("file"), pos.alias("pos"))


def encode_position(connector: str, position: dict) -> str:
    """JSON of a position: MySQL has file and pos, Postgres lsn."""
    keys = ("file", "pos") if connector == "mysql" else ("lsn",)
    return json.dumps({"connector": connector, **{k: position[k] for k in keys}}, separators=(",", ":"))


def decode_position(text: str) -> tuple:
    """The comparable value of :func:`encode_position`."""
    got = json.loads(text)
    return (got["file"], got["pos"]) if got["connector"] == "mysql" else (got["lsn"],)


def offsets_json(offsets: Column) -> Column:
    """Text of a map partition -> next offset, in order of partitions."""
    entries = F.array_sort(F.map_entries(offsets))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda x: F.concat(F.lit('"'), x["key"].cast("string"), F.lit('":'), x["value"].cast("string"))), ","), F.lit("}"))


def offsets_map(text: Column) -> Column:
    """The map of :func:`offsets_json`."""
    return F.transform_keys(F.from_json(text, "map<string,bigint>"), lambda k, _: k.cast("int"))
