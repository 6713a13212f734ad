"""References to records that are lacking, deleted or arrive later.

References are first reduced to their distinct keys, each with the earliest load of a row that refers to it; that is
combined before the shuffle, so a key to which a third of all rows refer costs one row per task. Keys of both sides are cut
into ranges, as many as there are tasks and more where ranges would grow beyond ``range_keys``. Each range of parents is a
sorted array, and the keys referred to in the same range are probed against it in one vectorised batch by binary search.
Only misses leave the probe, and are joined back to the rows that refer to them, hot keys spread over several tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .skew import join_groups, place, quantiles

#: Kinds of a miss, by what the probe says of a key.
KINDS = ("missing", "deleted", "late")
_NEVER = 2**63 - 1


def parent_states(parents: DataFrame, key: str, loaded_us: str, deleted: str) -> DataFrame:
    """One row per parent key: ``_key``, ``_loaded`` (its earliest load; no load is known to be late if none is known), ``_gone`` (whether some row has a deletion). Null keys are no parents."""
    rows = parents.filter(F.col(key).isNotNull())
    return rows.groupBy(F.col(key).alias("_key")).agg(F.coalesce(F.min(loaded_us), F.lit(-_NEVER)).alias("_loaded"), F.coalesce(F.bool_or(F.col(deleted).isNotNull()), F.lit(False)).alias("_gone"))


def _probe(key: tuple, refs, parents):
    """Misses of one range: binary search of all keys referred to in the sorted parents at once."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    want = refs.column("_ref").to_numpy()
    keys = parents.column("_key").to_numpy()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    loaded = parents.column("_loaded").to_numpy()[order]
    gone = parents.column("_gone").to_numpy(zero_copy_only=False)[order]
    if len(keys) == 0:
        kind, since = np.zeros(len(want), dtype=np.int32), np.full(len(want), -_NEVER)
    else:
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        since = loaded[at]
        kind = np.where(keys[at] != want, 0, np.where(gone[at], 1, np.where(since > refs.column("_seen").to_numpy(), 2, 3))).astype(np.int32)
    out = refs.select(["_ref", "_copies"]).append_column("_kind", pa.array(kind, pa.int32())).append_column("_loaded", pa.array(since, pa.int64()))
    return out.filter(pc.less(out.column("_kind"), 3))


def orphans(children: DataFrame, parents: DataFrame, child_id: str, ref: str, loaded_us: str, period: str, *, range_keys: int = 200_000, salt_rows: int = 500_000) -> DataFrame:
    """Distinct references that point nowhere: child_id, ref_id, kind, period.

    ``children``: columns ``child_id``, ``ref``, ``loaded_us`` (microseconds) and ``period`` (text); rows with a null
    reference are no cases. Where a time of load is unknown on either side nothing is late. ``parents`` comes from
    :func:`parent_states`. No parents at all make every reference missing. Repeated rows are one case. ``salt_rows``: rows
    that refer to one lacking key from which they are spread.
    """
    refs = children.filter(F.col(ref).isNotNull()).select(F.col(child_id).alias("child_id"), F.col(ref).cast("bigint").alias("_ref"), F.coalesce(F.col(loaded_us), F.lit(_NEVER)).alias("_seen"), F.col(period).alias("period"))
    # both sides are read twice, to find the ranges and to probe; one row per key
    keys = materialise(refs.groupBy("_ref").agg(F.min("_seen").alias("_seen"), F.count(F.lit(1)).alias("_copies")), "references")
    parents = materialise(parents, "parents")
    every = keys.select("_ref").unionByName(parents.select(F.col("_key").alias("_ref")))
    parts = max(children.sparkSession.sparkContext.defaultParallelism, math.ceil(every.count() / range_keys))
    cuts = sorted(set(quantiles(every, "_ref", parts)))
    probed = keys.withColumn("_range", place(F.col("_ref"), cuts)).groupBy("_range").cogroup(parents.withColumn("_range", place(F.col("_key"), cuts)).groupBy("_range"))
    misses = materialise(probed.applyInArrow(_probe, "_ref bigint, _copies bigint, _kind int, _loaded bigint"), "misses").withColumnRenamed("_ref", "_key")
    hit = join_groups(refs, misses, {"_ref": "_key"}, "_copies", ["child_id", "_seen"], salt_rows)
    # of a key that some row refers to too early only those rows are late
    hit = hit.filter((F.col("_kind") < 2) | (F.col("_loaded") > F.col("_seen")))
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("_kind") + 1)
    return hit.select("child_id", F.col("_ref").alias("ref_id"), kind.alias("kind"), "period").distinct()


def report(misses: DataFrame) -> DataFrame:
    """Misses per table, kind and period: how many references, how many keys."""
    return misses.groupBy("child_table", "kind", "period").agg(F.count(F.lit(1)).alias("cases"), F.countDistinct("ref_id").alias("keys"))
