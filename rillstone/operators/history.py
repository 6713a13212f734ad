"""Versions of changing attributes by gaps and islands.

An *observation* says that an entity had an attribute at a place in an order. Neighbouring observations with the same
attribute form an island, which is one version. The lag comparison of an attribute hash (confirmed on the value, so that
a collision can't join two versions) marks changes, a running sum numbers islands, the first observation gives the start
and the start of the next island the end.

Entities may be hot: with ``chunks`` over 1 the order is cut at its quantiles and islands are found per entity and chunk.
Only the first and last island of a chunk can touch another chunk, so a second, small pass stitches those edges, and no
task ever sees more of an entity than one chunk and two rows per chunk. Updates are cut into as many chunks as the entity
with the most of them needs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, micros
from .skew import place, quantiles

#: Rows of an entity that one window task may hold.
CHUNK_ROWS = 1_000_000


def _same(attr: str, hash_: str, order: str, w, stepwise: bool) -> Column:
    """Whether an observation goes on with the version of the one before it."""
    same = F.col(hash_).eqNullSafe(F.lag(hash_).over(w)) & F.col(attr).eqNullSafe(F.lag(attr).over(w))
    if stepwise:
        same = same & (F.col(order) == F.lag("_last").over(w) + 1)
    return F.coalesce(same, F.lit(False))


def islands(obs: DataFrame, entity: str, order: str, attr: str, start: str, close: str, *, stepwise: bool = False, chunks: int = 1) -> DataFrame:
    """One row per version: ``entity``, ``attr``, ``valid_from``, ``valid_to``.

    ``obs`` holds at most one row per entity and order. ``start``: the time at which a version that begins with this row
    begins; ``close``: the time at which a version that ends with this row ends if no other follows it. ``stepwise``: a
    step of more than one in ``order`` is a gap that ends a version, and the version after a gap doesn't close the one
    before. Rows whose entity or order is null belong to no version and are left out; a null attribute is a value of its
    own. No observations give no versions.
    """
    rows = obs.filter(F.col(entity).isNotNull() & F.col(order).isNotNull()).select(
        F.col(entity).alias("_e"), F.col(order).alias("_o"), F.col(order).alias("_last"), F.col(attr).alias("_a"), F.xxhash64(F.col(attr)).alias("_h"), F.col(start).alias("_s"), F.col(close).alias("_c")
    )
    cuts = sorted(set(quantiles(rows, "_o", chunks)))
    rows = rows.withColumn("_k", place(F.col("_o"), cuts))

    keys = ["_e", "_k"] if cuts else ["_e"]
    w = Window.partitionBy(*keys).orderBy("_o")
    change = (~_same("_a", "_h", "_o", w, stepwise)).cast("int")
    runs = rows.withColumn("_chg", change).withColumn("_i", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    local = runs.groupBy(*keys, "_i").agg(
        F.min_by("_s", "_o").alias("_s"), F.min("_o").alias("_o"), F.max("_o").alias("_last"), F.max_by("_c", "_o").alias("_c"), F.min_by("_a", "_o").alias("_a"), F.first("_h").alias("_h")
    )
    wi = Window.partitionBy(*keys).orderBy("_i")
    local = local.withColumn("_n", F.lead(F.struct("_s", "_o")).over(wi))
    if cuts:
        # read once by each half: the islands of all chunks are few beside the rows
        local = materialise(local.withColumn("_edge", (F.col("_i") == 1) | F.col("_n").isNull()), "islands")
        inner = local.filter(~F.col("_edge"))
        we = Window.partitionBy("_e").orderBy("_o")
        glued = (F.col("_i") == 1) & _same("_a", "_h", "_o", we, stepwise)
        edge = local.filter("_edge").withColumn("_chg", (~glued).cast("int")).withColumn("_j", F.sum("_chg").over(we.rowsBetween(Window.unboundedPreceding, 0)))
        edge = edge.groupBy("_e", "_j").agg(
            F.min_by("_s", "_o").alias("_s"), F.min("_o").alias("_first"), F.max("_last").alias("_last"), F.max_by("_c", "_o").alias("_c"), F.min_by("_a", "_o").alias("_a"),
            F.max(F.struct("_o", "_n")).getField("_n").alias("_in"),
        )
        edge = edge.withColumn("_n", F.coalesce("_in", F.lead(F.struct("_s", F.col("_first").alias("_o"))).over(Window.partitionBy("_e").orderBy("_j"))))
        cols = ["_e", "_a", "_s", "_last", "_c", "_n"]
        local = inner.select(*cols).unionByName(edge.select(*cols))
    follows = F.col("_n").isNotNull()
    if stepwise:
        follows = follows & (F.col("_n._o") == F.col("_last") + 1)
    return local.select(F.col("_e").alias(entity), F.col("_a").alias(attr), F.col("_s").alias("valid_from"), F.when(follows, F.col("_n._s")).otherwise(F.col("_c")).alias("valid_to"))


def snapshot_history(extracts: DataFrame, entity: str, attr: str, updated: str, taken: str) -> DataFrame:
    """Versions of ``attr`` from periodic full extracts taken at ``taken``.

    Of several rows of an entity in an extract the one with the latest ``updated`` counts (on ties the largest value,
    nulls first). Times are microseconds; -1 means that the version reaches the last extract. Repeated and late rows
    change nothing, for rows are first reduced per entity and extract, which also bounds what one entity can hold to the
    number of extracts. Rows without entity or time of extract are left out.
    """
    rows = extracts.select(F.col(f"`{entity}`").alias(entity), F.col(f"`{attr}`").alias(attr), micros(extracts, updated).alias("_upd"), micros(extracts, taken).alias("_taken")).filter(F.col(entity).isNotNull() & F.col("_taken").isNotNull())
    reduced = rows.groupBy(entity, "_taken").agg(F.max(F.struct("_upd", attr)).alias("_r"))
    # as many rows as there are extracts
    taken_at = rows.select("_taken").distinct()
    w = Window.orderBy("_taken")
    taken_at = taken_at.select("_taken", F.row_number().over(w).alias("_ord"), F.coalesce(F.lead("_taken").over(w), F.lit(-1)).alias("_close"))
    obs = reduced.join(taken_at, "_taken").select(entity, "_ord", F.col(f"_r.{attr}").alias(attr), F.coalesce(F.col("_r._upd"), F.col("_taken")).alias("_start"), "_close")
    return islands(obs, entity, "_ord", attr, "_start", "_close", stepwise=True)


def update_history(states: DataFrame, entity: str, attr: Column, updated: str, deleted: str, *, chunks: int | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Versions of the expression ``attr`` from the states of an entity in order of ``updated``.

    A state loaded twice counts once: of its rows the largest attribute and the latest ``deleted`` are taken. The last
    version ends at the deletion of its last state, else it is open (-1). Rows without entity or ``updated`` are left
    out. ``chunks`` of time, by default one for each ``chunk_rows`` states of the entity with the most states, keep it
    from falling to one task; the reduced states are written once, for they are read several times.
    """
    rows = states.select(F.col(f"`{entity}`").alias(entity), attr.alias("_attr"), micros(states, updated).alias("_upd"), micros(states, deleted).alias("_del"))
    rows = rows.filter(F.col(entity).isNotNull() & F.col("_upd").isNotNull()).groupBy(entity, "_upd").agg(F.max("_attr").alias("_attr"), F.coalesce(F.max("_del"), F.lit(-1)).alias("_close"))
    rows = materialise(rows, "states")
    if chunks is None:
        most = rows.groupBy(entity).count().agg(F.max("count")).head()[0] or 0
        chunks = max(1, math.ceil(most / chunk_rows))
    return islands(rows, entity, "_upd", "_attr", "_upd", "_close", chunks=chunks)
