"""Exactly one copy of each message that was delivered at least once.

Identifiers are split by their aggregated frequency. An identifier seen once needs no ranking: its only row is already
known from the aggregate and passes directly. Only rows of repeated identifiers are joined with the frequencies and ranked;
hot identifiers are salted before that join, so that even one with a third of all rows is spread over many tasks. Each part
of a group is ranked on its own, and the best of a part is the best of its group if it equals the first arrival that the
aggregate knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .skew import join_groups


def frequency(messages: DataFrame, ident: list[str], arrived: str, tie: str) -> DataFrame:
    """Per identifier: its copies ``_copies`` and its first arrival ``_first`` (``arrived``, nulls last, then ``tie``); combined before the shuffle."""
    return messages.groupBy(*ident).agg(F.count(F.lit(1)).alias("_copies"), F.min(F.struct(F.col(arrived).isNull().alias("_late"), arrived, F.col(tie).isNull().alias("_none"), tie)).alias("_first"))


def _ranked(messages: DataFrame, ident: list[str], arrived: str, tie: str, group_rows: int, carry: list[str] | None = None) -> DataFrame:
    """Rows of repeated identifiers, of which ``tie`` or the columns ``carry``, with ``_extra``: whether another copy is taken."""
    carry = carry or [tie]
    rows = messages.select(*dict.fromkeys([*ident, arrived, tie, *carry]))
    often = frequency(rows, ident, arrived, tie).filter("_copies > 1").select(*[F.col(c).alias(f"_id_{c}") for c in ident], "_copies", "_first")
    joined = join_groups(rows, materialise(often, "repeated"), {c: f"_id_{c}" for c in ident}, "_copies", [tie], group_rows)
    # rows equal in time and tie have one salt, so that exactly one of a group is first and equals the first arrival
    w = Window.partitionBy(*ident, "_salt").orderBy(F.col(arrived).asc_nulls_last(), F.col(tie).asc_nulls_last())
    first = F.col(arrived).eqNullSafe(F.col(f"_first.{arrived}")) & F.col(tie).eqNullSafe(F.col(f"_first.{tie}"))
    return joined.withColumn("_r", F.row_number().over(w)).select(*carry, ((F.col("_r") > 1) | ~first).alias("_extra"))


def extra_copies(messages: DataFrame, ident: list[str], arrived: str, tie: str, *, group_rows: int = 1_000_000) -> DataFrame:
    """``tie`` of every row other than the first arrival of its identifier.

    ``tie`` must be unique per row and decides between equal times; null times count as latest, null parts of an
    identifier equal each other. No messages give no rows. ``group_rows``: copies from which a group is spread.
    """
    return _ranked(messages, ident, arrived, tie, group_rows).filter("_extra").select(tie)


def first_arrivals(messages: DataFrame, ident: list[str], arrived: str, tie: str, *, group_rows: int = 1_000_000) -> DataFrame:
    """``tie`` of exactly one row per identifier, the first arrival: singletons as the aggregate knows them, and the winners of the ranking."""
    once = frequency(messages, ident, arrived, tie).filter("_copies = 1").select(F.col(f"_first.{tie}").alias(tie))
    return once.unionByName(_ranked(messages, ident, arrived, tie, group_rows).filter(~F.col("_extra")).select(tie))


def deduplicate(stored: DataFrame, new: DataFrame | None, ident: list[str], arrived: str, tie: str, *, group_rows: int = 1_000_000) -> DataFrame:
    """All columns of exactly one row per identifier over the stored and the new messages together.

    Rows go through the aggregate and the ranking as a whole, so that ``tie`` may be null (latest of equal times) or
    repeated: of rows equal in time and ``tie``, any one comes out. Columns that only one side has are null on the other.
    Extra columns may have any name.
    """
    both = stored if new is None else stored.unionByName(new, allowMissingColumns=True)
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(both.columns)))}
    cols = [f"c{i}" for i in range(len(both.columns))]
    rows, own, when, last = both.toDF(*cols), [at[c] for c in ident], at[arrived], at[tie]
    # a value each instead of a struct, so that unused columns are pruned; groups of several rows are dropped
    alone = rows.groupBy(*own).agg(F.count(F.lit(1)).alias("_copies"), *[F.first(c).alias(c) for c in cols if c not in own]).filter("_copies = 1").select(*cols)
    ranked = _ranked(rows, own, when, last, group_rows, cols).filter(~F.col("_extra")).select(*cols)
    return alone.unionByName(ranked).toDF(*both.columns)
