import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillstone.operators import reconcile as rc

SCHEMA = "id bigint, a string, b string, u bigint, h string, bucket string"
NAMES = ("only_left", "only_right")


def brute(left, right):
    l, r = {x[:4] for x in left}, {x[:4] for x in right}
    out = set()
    for k in {x[0] for x in l | r}:
        x, y = [v for v in l if v[0] == k], [v for v in r if v[0] == k]
        if not y:
            out.add((k, NAMES[0]))
        elif not x:
            out.add((k, NAMES[1]))
        else:
            out |= {(k, f) for i, f in ((1, "a"), (2, "b"), (3, "u")) if {v[i] for v in x} != {v[i] for v in y}}
    return sorted(out, key=repr)


def test_products_of_large_numbers():
    rng = random.Random(1)
    xs = [0, 1, rc.P - 1, 2**60, 2**32, 2**32 - 1] + [rng.randrange(rc.P) for _ in range(300)]
    ys = xs[::-1]
    got = rc.mulmod(np.array(xs, np.uint64), np.array(ys, np.uint64))
    assert [int(g) for g in got] == [x * y % rc.P for x, y in zip(xs, ys)]


def evaluate(hashes, n):
    out = []
    for z in rc.points(n):
        v = 1
        for h in hashes:
            v = v * (z - h) % rc.P
        out.append(v)
    return out


@pytest.mark.parametrize("only_a,only_b,common", [(0, 0, 5), (1, 0, 0), (0, 3, 20), (4, 4, 30), (5, 1, 2), (2, 6, 0)])
def test_interpolation_recovers_exactly_the_differing_roots(only_a, only_b, common):
    rng = random.Random(only_a * 100 + only_b)
    hs = rng.sample(range(2**60), only_a + only_b + common)
    a, b = hs[:only_a] + hs[only_a + only_b :], hs[only_a:]
    for bound in (1, 2, 4, 8, 16, 32):
        n = bound + rc.CHECKS
        got = rc.interpolate(len(a), len(b), evaluate(a, n), evaluate(b, n), bound)
        if got is None:
            assert bound < only_a + only_b + 2
            continue
        assert {h for h in hs if rc._value(got[0], h) == 0} == set(hs[:only_a]) and len(got[0]) == only_a
        assert {h for h in hs if rc._value(got[1], h) == 0} == set(hs[only_a : only_a + only_b]) and len(got[1]) == only_b
    assert got is not None


def test_differences_match_brute_force_and_double_their_bound(spark, rows):
    rng = random.Random(4)
    left = [(i, rng.choice(["x", "", None, f"n{i}"]), f"b{i}", rng.choice([None, i]), "h", None) for i in range(300)]
    left += [(None, "q", "q", 1, "h", None), (5, "second", "row", 5, "h", None)] + left[:20]
    right = []
    for x in left:
        p = rng.random()
        if p < 0.1:
            continue
        right.append((x[0], None if p < 0.2 else x[1], x[2] + "!" if p > 0.9 else x[2], x[3], "other", "z"))
    right += [(1000 + i, "new", None, i, None, None) for i in range(15)]
    l, r = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    want = brute(left, right)
    for bucket_rows, bound in ((128, 16), (40, 1)):
        assert rows(rc.differences(l, r, "id", ["a", "b", "u"], NAMES, bucket_rows=bucket_rows, bound=bound)) == want


def test_empty_and_equal_copies(spark, rows):
    df = spark.createDataFrame([(i, "a", "b", i, None, None) for i in range(50)], SCHEMA)
    none = df.filter("false")
    args = ("id", ["a", "b", "u"], NAMES)
    assert rows(rc.differences(df, df, *args)) == [] and rows(rc.differences(none, none, *args)) == []
    assert rows(rc.differences(df, none, *args)) == sorted([(i, "only_left") for i in range(50)], key=repr)


def test_hot_key_with_many_rows(spark, rows):
    l = spark.range(2000).select(F.lit(1).cast("bigint").alias("id"), F.col("id").cast("string").alias("a"), F.lit("b").alias("b"), F.lit(1).cast("bigint").alias("u"))
    r = l.filter("a <> '77'")
    assert rows(rc.differences(l, r, "id", ["a", "b", "u"], NAMES)) == [(1, "a")]
