import random

from rillstone.operators import lww

FIELDS = {"x": ("x", "x is not null"), "y": ("y", "y is not null")}


def brute(changes):
    state = {}
    for k, seq, op, x, y in sorted((c for c in changes if c[1] is not None), key=lambda c: (c[1], c[2] == "d")):
        if op in ("r", "c"):
            state[k] = [seq, x, y]
        elif op == "u":
            s = state.setdefault(k, [seq, None, None])
            s[0] = seq
            s[1] = x if x is not None else s[1]
            s[2] = y if y is not None else s[2]
        elif op == "d":
            state.pop(k, None)
    return sorted(((k, *v) for k, v in state.items()), key=repr)


def test_last_writer_per_column_matches_applying_in_order(spark, rows):
    rng = random.Random(2)
    for trial in range(4):
        seqs = rng.sample(range(1000), 200)
        changes = [(rng.choice([1, 1, 1, 2, 3, None]), s, rng.choice(["r", "c", "u", "u", "u", "d", "m", None]), rng.choice([None, f"x{s}"]), rng.choice([None, s])) for s in seqs]
        feed = changes + rng.sample(changes, 60) + [(1, None, "u", "q", 1)]
        rng.shuffle(feed)
        df = spark.createDataFrame(feed, "k bigint, seq bigint, op string, x string, y bigint")
        got = lww.apply_changes(df, ["k"], "seq", "op", FIELDS, replace_ops=["r", "c"], patch_ops=["u"], delete_ops=["d"])
        assert rows(got) == brute(changes)


def test_replacements_set_what_they_lack_to_null(spark, rows):
    df = spark.createDataFrame([(1, 1, "c", "a", 1), (1, 2, "u", "b", None)], "k bigint, seq bigint, op string, x string, y bigint")
    got = lww.apply_changes(df, ["k"], "seq", "op", FIELDS, replace_ops=["r", "c", "u"], patch_ops=[], delete_ops=["d"])
    assert rows(got) == [(1, 2, "b", None)]


def test_delete_wins_at_the_same_sequence_and_nothing_gives_nothing(spark, rows):
    df = spark.createDataFrame([(1, 1, "c", "a", 1), (1, 1, "d", None, None)], "k bigint, seq bigint, op string, x string, y bigint")
    args = dict(replace_ops=["c"], patch_ops=[], delete_ops=["d"])
    assert rows(lww.apply_changes(df, ["k"], "seq", "op", FIELDS, **args)) == []
    assert rows(lww.apply_changes(df.filter("false"), ["k"], "seq", "op", {}, **args)) == []
