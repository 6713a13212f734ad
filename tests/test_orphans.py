import random

from rillstone.operators import orphans


def brute(children, parents):
    by = {}
    for k, loaded, gone in parents:
        if k is not None:
            x = by.setdefault(k, [None, False])
            if loaded is not None:
                x[0] = loaded if x[0] is None else min(x[0], loaded)
            x[1] = x[1] or gone is not None
    out = set()
    for c, ref, loaded, period in children:
        if ref is None:
            continue
        p = by.get(ref)
        if p is None:
            kind = "missing"
        elif p[1]:
            kind = "deleted"
        elif loaded is not None and p[0] is not None and p[0] > loaded:
            kind = "late"
        else:
            continue
        out.add((c, ref, kind, period))
    return sorted(out, key=repr)


def test_binary_search_matches_brute_force_over_ranges_and_salts(spark, rows):
    rng = random.Random(11)
    parents = [(rng.randint(-50, 200), rng.choice([None, rng.randint(0, 100)]), rng.choice([None, None, None, 5])) for _ in range(150)] + [(None, 1, None)]
    children = [(rng.choice([None, i]), 7 if rng.random() < 0.4 else rng.choice([None, rng.randint(-60, 210)]), rng.choice([None, rng.randint(0, 100)]), rng.choice(["2025-01", "2025-02", None])) for i in range(500)]
    children += children[:40]
    c = spark.createDataFrame(children, "cid bigint, ref bigint, loaded bigint, period string")
    p = spark.createDataFrame(parents, "k bigint, l bigint, d bigint")
    want = brute(children, parents)
    for range_keys, salt_rows in ((1000, 1000), (10, 1000), (10, 15), (1, 1)):
        got = orphans.orphans(c, orphans.parent_states(p, "k", "l", "d"), "cid", "ref", "loaded", "period", range_keys=range_keys, salt_rows=salt_rows)
        assert rows(got) == want


def test_empty_sides(spark, rows):
    c = spark.createDataFrame([(1, 2, 3, "2025-01")], "cid bigint, ref bigint, loaded bigint, period string")
    none = spark.createDataFrame([], "k bigint, l bigint, d bigint")
    states = orphans.parent_states(none, "k", "l", "d")
    assert rows(orphans.orphans(c, states, "cid", "ref", "loaded", "period")) == [(1, 2, "missing", "2025-01")]
    assert orphans.orphans(c.filter("false"), states, "cid", "ref", "loaded", "period").count() == 0
