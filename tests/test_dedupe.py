import random

from pyspark.sql import functions as F

from rillstone.operators import dedupe, feed

SCHEMA = "a string, b bigint, t bigint, id bigint, extra string"


def make(n, seed):
    rng = random.Random(seed)
    return [(rng.choice(["x", "y", None]), rng.choice([1, 2, None, rng.randint(3, 60)]) if rng.random() < 0.8 else 7, rng.choice([None, rng.randint(0, 5)]), i, rng.choice(["p", None])) for i in range(n)]


def firsts(data):
    best = {}
    for a, b, t, i, _ in data:
        k, rank = (a, b), (t is None, t or 0, i)
        if k not in best or rank < best[k][0]:
            best[k] = (rank, i)
    return {i for _, i in best.values()}


def test_one_copy_of_each_with_hot_groups_salted(spark):
    data = make(600, 3)
    df = spark.createDataFrame(data, SCHEMA)
    want = firsts(data)
    for group_rows in (1_000_000, 5):
        got = [r.id for r in dedupe.first_arrivals(df, ["a", "b"], "t", "id", group_rows=group_rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        extra = {r.id for r in dedupe.extra_copies(df, ["a", "b"], "t", "id", group_rows=group_rows).collect()}
        assert extra == {r[3] for r in data} - want
    assert {r._first.id for r in dedupe.frequency(df, ["a", "b"], "t", "id").collect()} == want


def test_stored_and_new_together(spark):
    data = make(100, 5)
    old = spark.createDataFrame(data[:50], SCHEMA)
    new = spark.createDataFrame(data[50:], SCHEMA).withColumn("more", F.lit(1))
    got = dedupe.deduplicate(old, new, ["a", "b"], "t", "id").collect()
    assert {r.id for r in got} == firsts(data) and "more" in got[0].asDict()


def test_no_messages(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert dedupe.first_arrivals(df, ["a", "b"], "t", "id").count() == 0
    assert dedupe.extra_copies(df, ["a", "b"], "t", "id").count() == 0


def test_keys_and_files_in_all_spellings(spark):
    ks = ['{"actor_id": 83}', '{"actor_id":"83"}', '{"actor_id":83.0}', '{ "film_id" : 7 }', "{}", "nonsense", None, '{"actor_id":null}']
    df = spark.createDataFrame([(k,) for k in ks], "k string")
    assert [r[0] for r in df.select(feed.key_number(F.col("k"), ["actor_id", "film_id"])).collect()] == [83, 83, 83, 7, None, None, None, None]
    fs = ["mysql-bin.999999", "binlog.1000000", "a.b.000012", "plain", "", None]
    df = spark.createDataFrame([(f,) for f in fs], "f string")
    assert [r[0] for r in df.select(feed.file_number(F.col("f"))).collect()] == [999999, 1000000, 12, None, None, None]
