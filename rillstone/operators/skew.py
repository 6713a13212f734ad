"""What keeps one key, or one stretch of an order, from falling to one task.

Joins with a table of groups are salted: a group with so many rows that it counts as hot meets its rows in as many parts as
it needs. Which groups are hot has to be known to every task before the shuffle; they are broadcast, for their number has a
bound: a hot group holds more than one part in ``MOST_HOT`` of all rows, so there are fewer than ``MOST_HOT`` of them.

Orders are cut at quantiles of their first column; a value that alone fills several chunks is cut further by the next
column of the order, and so on. Any number of cuts is looked up by two steps of about its square root.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A hot group holds more than one part in this of all rows.
MOST_HOT = 10_000


def join_groups(rows: DataFrame, groups: DataFrame, on: dict[str, str], copies: str, salt_by: list[str], group_rows: int) -> DataFrame:
    """``rows`` joined with ``groups`` (one row per key, with the number of its rows in ``copies``; read three times) on ``on`` (column of rows -> column of groups).

    Nulls equal each other. Adds ``_salt``, a number that follows from ``salt_by`` and is 0 for all but hot groups, those
    with more than ``group_rows`` rows and more than one part in ``MOST_HOT`` of all. No task gets more than a part of a
    hot group.
    """
    total = groups.agg(F.sum(copies)).head()[0] or 0
    most = max(group_rows, total // MOST_HOT)
    salts = F.ceil(F.col(copies) / F.lit(most)).cast("bigint")
    hot = groups.filter(F.col(copies) > most).select(*[F.col(g).alias(f"_hot_{r}") for r, g in on.items()], salts.alias("_salts"))
    same = reduce(and_, [F.col(r).eqNullSafe(F.col(f"_hot_{r}")) for r in on])
    salted = rows.join(F.broadcast(hot), same, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*salt_by), F.col("_salts")), F.lit(0).cast("bigint"))).drop("_salts", *[f"_hot_{r}" for r in on])
    spread = groups.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.when(F.col(copies) > most, salts - 1).otherwise(F.lit(0)).cast("bigint"))))
    same = reduce(and_, [F.col(r).eqNullSafe(F.col(g)) for r, g in on.items()]) & (F.col("_salt") == F.col("_part"))
    return salted.join(spread, same).drop("_part")


def quantiles(df: DataFrame, col: str, parts: int) -> list:
    """``parts`` - 1 values of ``col`` at equal distances in its order, fewer if there are no rows; a value that fills several parts stands several times."""
    if parts <= 1:
        return []
    return list(df.agg(F.percentile_approx(col, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).head()[0] or [])


def place(col: Column, cuts: list) -> Column:
    """How many of the sorted, distinct ``cuts`` lie below a value: a search over every k-th cut as nested conditions, then over the k cuts up to the next."""
    step = max(1, math.isqrt(len(cuts)))
    if not cuts:
        return F.lit(0)

    def coarse(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col <= F.lit(cuts[mid * step + step - 1]), coarse(lo, mid)).otherwise(coarse(mid + 1, hi))

    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    full = len(cuts) // step
    block = coarse(0, full)
    table = F.array(*[F.array(*[F.lit(c) for c in b]) for b in blocks])
    within = F.coalesce(F.size(F.filter(F.get(table, block), lambda c: c < col)), F.lit(0))
    return block * step + F.greatest(within, F.lit(0))


def chunks(df: DataFrame, order: list[str], parts: int) -> list[tuple[object, list]]:
    """Cuts of ``order`` into about ``parts`` chunks: per cut of the first column the value and, where it fills chunks of its own, the cuts of the rest of the order among its rows."""
    got = quantiles(df, order[0], parts)
    out = []
    for v in sorted(set(got)):
        n = got.count(v)
        below = chunks(df.filter(F.col(order[0]) == F.lit(v)), order[1:], n) if n > 1 and len(order) > 1 else []
        out.append((v, below))
    return out


def _width(cuts: list[tuple[object, list]]) -> int:
    """Numbers that a value of the first column may take up: its own chunks, and the rows that lie below it."""
    return max([(len(below) + 1) * _width(below) + 1 for _, below in cuts if below], default=1)


def chunk_number(order: list[str], cuts: list[tuple[object, list]]) -> Column:
    """Number of a row's chunk, rising with the order, for cuts of :func:`chunks`."""
    if not cuts:
        return F.lit(0).cast("bigint")
    at = (place(F.col(order[0]), [v for v, _ in cuts]) * F.lit(_width(cuts))).cast("bigint")
    for v, below in cuts:
        if below:
            # rows of the value come after those of the chunk that lie below it
            at = F.when(F.col(order[0]) == F.lit(v), at + 1 + chunk_number(order[1:], below)).otherwise(at)
    return at
