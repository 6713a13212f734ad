"""Scans, order, duplicates, batches and net changes against sequential restatements and the golden cases."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from rillstone.operators import netchange as nc
from rillstone.operators.scan import running

LOG = "place bigint, op string, id bigint, v string, ts bigint, lsn bigint, day string"


def test_running_values_in_every_chunking(spark):
    rng = random.Random(3)
    data = [(i * 2, rng.choice([None, rng.randint(-9, 9)])) for i in range(200)]
    df = spark.createDataFrame(data, "o bigint, x bigint")
    want, total, top, before = [], None, None, None
    for n, (o, x) in enumerate(data):
        prev_top = top
        total = total if x is None else (total or 0) + x
        top = top if x is None else x if top is None else max(top, x)
        want.append((o, n + 1, total, top, prev_top, before))
        before = x
    adds = {"row": ("row", None), "s": ("sum", F.col("x")), "m": ("max", F.col("x")), "mb": ("max_before", F.col("x")), "l": ("lag", F.col("x"))}
    for chunk_rows in (1000, 60, 7):
        got = [tuple(r) for r in running(df, ["o"], adds, chunk_rows=chunk_rows).orderBy("o").select("o", "row", "s", "m", "mb", "l").collect()]
        assert got == want


def test_running_values_per_group(spark):
    rng = random.Random(8)
    data = [(rng.choice("ab"), i, rng.choice([None, rng.randint(-9, 9)])) for i in range(150)]
    df = spark.createDataFrame(data, "g string, o bigint, x bigint")
    for chunk_rows in (1000, 20):
        got = {(r.g, r.o): r for r in running(df, ["o"], {"row": ("row", None), "m": ("max", F.col("x")), "l": ("lag", F.col("x"))}, by=("g",), chunk_rows=chunk_rows).collect()}
        for g in "ab":
            own = [x for x in data if x[0] == g]
            for n, (_, o, _) in enumerate(own):
                seen = [x for _, _, x in own[: n + 1] if x is not None]
                r = got[g, o]
                assert (r.row, r.m, r.l) == (n + 1, max(seen) if seen else None, own[n - 1][2] if n else None)


def test_merge_order_is_that_of_a_heap(spark):
    rng = random.Random(5)
    parts = {p: [(rng.randint(0, 50), o) for o in range(rng.randint(1, 30))] for p in range(4)}
    heap = [(xs[0][0], p, 0) for p, xs in parts.items()]
    heapq.heapify(heap)
    want = []
    while heap:
        _, p, i = heapq.heappop(heap)
        want.append((p, i))
        if i + 1 < len(parts[p]):
            heapq.heappush(heap, (parts[p][i + 1][0], p, i + 1))
    df = spark.createDataFrame([(p, o, t) for p, xs in parts.items() for t, o in xs], "p int, o bigint, t bigint")
    for chunk_rows in (10_000, 9):
        assert [(r.p, r.o) for r in nc.merge_order(df, "p", "o", "t", chunk_rows=chunk_rows).orderBy("place").collect()] == want


@pytest.mark.parametrize("ts,lsn,dup", [(1, 2**63 - 1, True), (2**63 - 1, 1, True), (555555555, 55554, True), (555555555, 55555, True), (555555555, 55556, False), (555555556, 55556, False)])
def test_duplicates_against_committed_marks(spark, ts, lsn, dup):
    df = spark.createDataFrame([(1, ts, lsn)], "place bigint, ts bigint, lsn bigint")
    got = nc.high_water(df, "place", F.col("ts"), F.col("lsn"), seed_ts=555555555, seed_wal=F.lit(55555).cast("bigint")).first()
    assert got.dup is dup


def sequential(log, size):
    """The table, applied record by record."""
    mts = mw = None
    table, batch, live, n, day, was_t = [], 0, {}, 0, None, False
    for place, op, i, v, ts, lsn, d in log:
        dup = mts is not None and (mts > ts or mw >= lsn)
        mts, mw = max(ts, mts or ts), max(lsn, mw or lsn)
        if place == log[0][0] or d != day or n == size or op == "t" or was_t:
            batch, live, n = batch + 1, {}, 0
        day, n, was_t = d, n + 1, op == "t"
        if op == "t":
            table = []
        elif op in ("r", "c", "u", "d"):
            if i in live:
                table.remove(live.pop(i))
            elif op != "c" or dup:
                table = [r for r in table if r[0] != i or r[3] == batch]
            if op != "d":
                live[i] = (i, v, place, batch)
                table.append(live[i])
    return sorted(r[:2] for r in table)


def planned(spark, log, size, chunk_rows=1000):
    df = spark.createDataFrame(log, LOG)
    df = nc.batches(nc.high_water(df, "place", F.col("ts"), F.col("lsn"), chunk_rows=chunk_rows), "place", size, ["day"], chunk_rows=chunk_rows)
    net = nc.net_changes(df, ["id"], "place")
    return sorted((r.id, r.v) for r in nc.state(net, ["id"], truncated=nc.last_truncate(df)).collect())


@pytest.mark.parametrize("seed", range(4))
def test_plans_match_applying_in_order_also_malformed_logs(spark, seed):
    rng = random.Random(seed)
    ops = ["r", "c", "c", "u", "u", "u", "d", "m"] + (["t"] if seed % 2 else [])
    log = [(n, rng.choice(ops), rng.randint(1, 6), f"v{n}", 100 + n + rng.choice([0, 0, 0, -5]), n + rng.choice([1, 1, 1, -3]), f"d{n // 25}") for n in range(80)]
    for chunk_rows in (1000, 13):
        assert planned(spark, log, 10, chunk_rows) == sequential(log, 10)


E = lambda n, op, i, v, ts=0, lsn=None: (n, op, i, v, ts, n if lsn is None else lsn, "d")


def test_golden_two_commits(spark):
    one = [("c", 1, "aaa"), ("c", 2, "bbb"), ("c", 3, "ccc"), ("u", 2, "ddd"), ("u", 1, "eee"), ("c", 4, "fff"), ("c", 5, "ggg"), ("d", 3, None)]
    two = [("u", 2, "hhh"), ("u", 5, "iii"), ("d", 4, None)]
    log = [E(n, *x) for n, x in enumerate(one)]
    assert planned(spark, log, 100) == [(1, "eee"), (2, "ddd"), (4, "fff"), (5, "ggg")]
    log += [(n + 8, *x, 0, n + 8, "e") for n, x in enumerate(two)]
    assert planned(spark, log, 100) == [(1, "eee"), (2, "hhh"), (5, "iii")]


T = 555555555


@pytest.mark.parametrize("cut", [100, 3, 4])
def test_golden_read_then_create_and_retried_batches(spark, cut):
    reads = [("r", 4, "4", T, 555), ("r", 5, "5", T, 555), ("r", 6, "6", T, 555), ("c", 5, "5", 444444444, 666), ("c", 7, "7", 444444444, 667)]
    assert planned(spark, [E(n, *x) for n, x in enumerate(reads)], cut) == [(4, "4"), (5, "5"), (6, "6"), (7, "7")]
    first = [("c", 5, "555", T, 555), ("u", 5, "556", T, 566), ("u", 5, "557", T, 577), ("c", 6, "666", T, 666)]
    again = first[:3] + [("c", 7, "777", T, 777)]
    assert planned(spark, [E(n, *x) for n, x in enumerate(first + again)], cut) == [(5, "557"), (6, "666"), (7, "777")]
