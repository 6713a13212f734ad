"""From an ordered change log to batches and their net changes.

Operations: r (read: an upsert by force), c (create: a plain insert unless the record may be a duplicate), u (update:
delete and insert), d (delete), t (truncate); anything else and tombstones change nothing. Instead of a state machine per
record, each batch is planned with windows over (batch, key): a record deletes by position if the record of its key before
it in the batch left a row, else by equality if it deletes at all, and its row survives if no later record of its key in
the batch follows. Rows that a batch itself supersedes are never written, so position deletes need no files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import CHUNK_ROWS, cuts_of, running

SETS, ROW_OPS, OPS = ("r", "c", "u"), ("r", "c", "u", "d"), ("r", "c", "u", "d", "t")


def known_ops(log: DataFrame) -> DataFrame:
    """Records that change something: no tombstones, no unknown operations."""
    return log.filter(F.col("op").isin(*OPS))


def merge_order(log: DataFrame, partition: str, offset: str, ts: str, *, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Order of a k-way merge of partitions by time: adds ``pm``, the largest time of the partition so far, and ``place``, the place in (pm, partition, offset).

    A record behind a later one of its partition waits for it, which is what a heap of partition heads does. Null times
    come first.
    """
    rows = running(log, [offset], {"pm": ("max", F.col(ts))}, by=(partition,), chunk_rows=chunk_rows).withColumn("pm", F.coalesce("pm", F.lit(-(2**63))))
    return running(rows, ["pm", partition, offset], {"place": ("row", None)}, chunk_rows=chunk_rows)


def high_water(log: DataFrame, order: str, ts: Column, wal: Column, *, seed_ts: int | None = None, seed_wal: Column | None = None, cuts: list | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds the largest time and position before each record (``hw_ts``, ``hw_wal``), the record's ``dup`` (it may be a duplicate: an earlier time or a position not beyond) and ``disorder`` (its time or position runs back).

    Seeds are the marks a table has already committed.
    """
    rows = running(log, [order], {"hw_ts": ("max_before", ts), "hw_wal": ("max_before", wal)}, cuts=cuts, chunk_rows=chunk_rows)
    if seed_ts is not None:
        rows = rows.withColumn("hw_ts", F.greatest("hw_ts", F.lit(seed_ts)))
    if seed_wal is not None:
        rows = rows.withColumn("hw_wal", F.greatest(F.col("hw_wal"), seed_wal))
    late, seen = F.coalesce(F.col("hw_ts") > ts, F.lit(False)), F.coalesce(F.col("hw_wal") >= wal, F.lit(False))
    back = F.coalesce(F.col("hw_wal") > wal, F.lit(False))
    return rows.withColumns({"dup": late | seen, "ts_back": late, "wal_back": back})


def batches(log: DataFrame, order: str, size: int, cut: list[str], *, cuts: list | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``bid``: batches are cut after ``size`` records, at every change of one of ``cut`` (source day, schema version), and around a truncate."""
    cuts = cuts_of(log, order, chunk_rows) if cuts is None else cuts
    same = [F.col(c) for c in cut]
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(same)], (F.col("op") == "t").alias("t"))
    one = running(log, [order], {"_prev": ("lag", key), "_row": ("row", None)}, cuts=cuts)
    change = (F.col("_prev").isNull() | ~key.eqNullSafe(F.col("_prev")) | (F.col("op") == "t")).cast("bigint")
    two = running(one.withColumn("_chg", change), [order], {"_start": ("max", F.when(F.col("_chg") == 1, F.col("_row")))}, cuts=cuts)
    first = (F.pmod(F.col("_row") - F.col("_start"), F.lit(size)) == 0).cast("bigint")
    return running(two.withColumn("_first", first), [order], {"bid": ("sum", F.col("_first"))}, cuts=cuts).drop("_prev", "_row", "_chg", "_start", "_first")


def net_changes(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds per record of a row operation: ``pos`` (it deletes by position), ``eq`` (it deletes by equality), ``survives`` (its row is what the batch leaves). ``log`` has bid and dup."""
    w = Window.partitionBy("bid", *keys).orderBy(order)
    rows = log.filter(F.col("op").isin(*ROW_OPS)).withColumns({"_prev": F.lag("op").over(w), "_next": F.lead("op").over(w)})
    live = F.coalesce(F.col("_prev").isin(*SETS), F.lit(False))
    deletes = F.col("op").isin("u", "d", "r") | ((F.col("op") == "c") & F.col("dup"))
    return rows.withColumns({"pos": live.cast("int"), "eq": (~live & deletes).cast("int"), "survives": (F.col("_next").isNull() & (F.col("op") != "d")).cast("int")}).drop("_prev", "_next")


def apply_equality_deletes(data: DataFrame, deletes: DataFrame, keys: list[str], seq: str, *, hint: str | None = None) -> DataFrame:
    """Rows of ``data`` not deleted by a later sequence: a row stays unless a delete of its key has a larger ``seq``.

    The comparison of sequences is folded into one row per key (its largest sequence), which makes the anti join an equi
    join that hashes or broadcasts as sizes allow, or goes as ``hint`` says. Null keys match null keys.
    """
    last = deletes.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(seq).alias("_del"))
    last = last.hint(hint) if hint else last
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return data.join(last, on, "left").filter(F.col("_del").isNull() | (F.col(seq) >= F.col("_del"))).drop("_del", *[f"_k_{k}" for k in keys])


def state(net: DataFrame, keys: list[str], upto: int | None = None, truncated: int | None = None) -> DataFrame:
    """Rows of the table after the batches up to ``upto`` (all if None), from :func:`net_changes`; ``truncated``: the batch of the last truncate, before which nothing is left."""
    if upto is not None:
        net = net.filter(F.col("bid") <= upto)
    if truncated is not None:
        net = net.filter(F.col("bid") > truncated)
    rows = net.filter("survives = 1")
    return apply_equality_deletes(rows, net.filter("eq = 1").select(*keys, "bid"), keys, "bid")


def last_truncate(log: DataFrame) -> int | None:
    """The batch of the last truncate, if there is one."""
    return log.filter("op = 't'").agg(F.max("bid")).head()[0]


def summaries(log: DataFrame, net: DataFrame, partition: str, offset: str, ts: str, wal: str) -> DataFrame:
    """One row per batch: records, position and equality deletes, data rows, and the marks its snapshot carries: the largest source time and position so far, and per partition the next offset so far."""
    counts = net.groupBy("bid").agg(F.sum("pos").alias("pos"), F.sum("eq").alias("eq"), F.sum("survives").alias("data"))
    marks = log.groupBy("bid").agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("_ts"), F.max(wal).alias("_wal"))
    per = marks.join(counts, "bid", "left")
    per = per.select("bid", "n", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("pos", "eq", "data")], "_ts", "_wal")
    per = running(per, ["bid"], {"source_ts": ("max", F.col("_ts")), "wal": ("max", F.col("_wal"))}).drop("_ts", "_wal")
    # a row per batch and partition it touches; the running maximum fills the others
    offs = log.groupBy("bid", F.col(partition).alias("part")).agg((F.max(offset) + 1).alias("next"))
    grid = per.select("bid", F.explode(F.array(*[F.lit(p) for p in _parts(log, partition)])).alias("part")).join(offs, ["bid", "part"], "left").withColumnRenamed("next", "_next")
    grid = running(grid, ["bid"], {"next": ("max", F.col("_next"))}, by=("part",)).drop("_next").filter("next is not null")
    text = grid.groupBy("bid").agg(F.array_sort(F.collect_list(F.struct("part", "next"))).alias("o"))
    text = text.select("bid", F.concat(F.lit("{"), F.array_join(F.transform("o", lambda x: F.concat(F.lit('"'), x["part"].cast("string"), F.lit('":'), x["next"].cast("string"))), ","), F.lit("}")).alias("offsets"))
    return per.join(text, "bid", "left")


def _parts(log: DataFrame, partition: str) -> list[int]:
    """Partitions of a topic: as many as the broker has."""
    return sorted(r[0] for r in log.select(partition).distinct().collect() if r[0] is not None)
