import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from rillstone.operators import history

OBS = "e bigint, o bigint, a string, s bigint, c bigint"


def brute(obs, stepwise):
    out = []
    by = {}
    for e, o, a, s, c in obs:
        if e is not None and o is not None:
            by.setdefault(e, []).append((o, a, s, c))
    for e, xs in by.items():
        xs.sort(key=lambda x: x[0])
        runs = []
        for x in xs:
            if runs and runs[-1][-1][1] == x[1] and (not stepwise or runs[-1][-1][0] + 1 == x[0]):
                runs[-1].append(x)
            else:
                runs.append([x])
        for i, r in enumerate(runs):
            nxt = runs[i + 1] if i + 1 < len(runs) else None
            follows = nxt and (not stepwise or r[-1][0] + 1 == nxt[0][0])
            out.append((e, r[0][1], r[0][2], nxt[0][2] if follows else r[-1][3]))
    return sorted(out, key=repr)


def test_islands_match_brute_force_in_every_chunking(spark, rows):
    rng = random.Random(7)
    obs = []
    for e in [1, 2, 3, None]:
        for o in sorted(rng.sample(range(400), 150 if e == 1 else 25)):
            obs.append((e, o, rng.choice(["x", "y", None, ""]) if rng.random() < 0.7 else "x", o * 10, o * 10 + 5))
    obs.append((1, None, "x", 1, 1))
    df = spark.createDataFrame(obs, OBS)
    for stepwise in (False, True):
        want = brute(obs, stepwise)
        for chunks in (1, 2, 7, 40):
            assert rows(history.islands(df, "e", "o", "a", "s", "c", stepwise=stepwise, chunks=chunks)) == want


def test_islands_with_one_long_version_over_all_chunks(spark, rows):
    obs = [(1, o, "same", o, 999) for o in range(100)]
    assert rows(history.islands(spark.createDataFrame(obs, OBS), "e", "o", "a", "s", "c", chunks=10)) == [(1, "same", 0, 999)]


def test_islands_of_nothing(spark):
    for chunks in (1, 4):
        assert history.islands(spark.createDataFrame([], OBS), "e", "o", "a", "s", "c", chunks=chunks).count() == 0


def test_snapshot_history_ties_gaps_and_clashing_columns(spark, rows):
    t = [datetime(2025, 1, 1) + timedelta(days=14 * i) for i in range(5)]
    us = lambda x: int((x - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    u = [datetime(2024, 1, d) for d in range(1, 9)]
    data = [
        (1, "a", u[0], t[0]), (1, "a", u[0], t[0]), (1, "b", u[1], t[1]), (1, "old", u[0], t[1]),  # read twice, once in an older state
        (1, "b", u[2], t[3]),  # gone at t[2], back with the same name
        (1, None, u[3], t[4]), (2, "z", u[4], t[2]), (None, "n", u[0], t[0]), (3, "q", u[0], None),
    ]
    df = spark.createDataFrame(data, "actor_id bigint, last_name string, last_update timestamp_ntz, extracted_at timestamp_ntz")
    df = df.withColumn("_o", F.lit("x")).withColumn("_e", F.lit(1)).withColumn("valid_from", F.lit(0))
    got = rows(history.snapshot_history(df, "actor_id", "last_name", "last_update", "extracted_at"))
    assert got == sorted(
        [(1, "a", us(u[0]), us(u[1])), (1, "b", us(u[1]), us(t[2])), (1, "b", us(u[2]), us(u[3])), (1, None, us(u[3]), -1), (2, "z", us(u[4]), us(t[3]))], key=repr
    )


def test_update_history_closes_at_the_last_deletion(spark, rows):
    d = lambda n: datetime(2025, 1, n)
    us = lambda n: int((d(n) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    data = [(1, "1", d(1), None), (1, "1", d(2), None), (1, "2", d(3), d(5)), (1, "2", d(3), None), (2, None, d(1), None), (2, "", d(2), None), (None, "1", d(1), None), (3, "1", None, None)]
    df = spark.createDataFrame(data, "id bigint, phone string, upd timestamp_ntz, del timestamp_ntz")
    got = rows(history.update_history(df, "id", F.nullif(F.col("phone"), F.lit("")), "upd", "del").drop("_attr"))
    assert got == sorted([(1, us(1), us(3)), (1, us(3), us(5)), (2, us(1), -1)], key=repr)
