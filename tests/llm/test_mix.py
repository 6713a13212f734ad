import math

import pytest

from rillstone.llm import mix

TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("none", 0.1, 5), ("zero", 0.0, 1)]


def test_rates_follow_shares_and_caps():
    got = {s.source: s for s in mix.plan(TARGETS, {"a": (10, 1000), "b": (5, 100), "c": (2, 500), "zero": (1, 5)})}
    assert got["b"].rate == 3.0 and got["none"].rate == 0 and got["zero"].rate == 0
    used = {k: got[k].rate * got[k].tokens for k in "abc"}
    for k in "abc":
        assert used[k] / sum(used.values()) == pytest.approx(got[k].goal) and got[k].rate <= got[k].cap
    assert sum(s.goal for s in got.values()) == pytest.approx(1)
    small = {s.source: s for s in mix.plan(TARGETS, {"a": (10, 1000), "b": (5, 100), "c": (2, 500)}, total=90)}
    assert small["a"].rate == pytest.approx(90 * 5 / 9 / 1000)
    assert all(s.rate == 0 for s in mix.plan(TARGETS, {}))
    assert mix.plan([], {"a": (1, 1)}) == [] and mix.plan([(None, 1.0, 1)], {}) == []


@pytest.fixture(scope="module")
def docs(spark):
    data = []
    for i in range(900):
        src = ["Web", "web ", "WEB", "news", "books", None, "unlisted"][i % 7]
        data.append((i, "word " * (3 + i % 11) if i % 50 else [None, "", "  "][i // 50 % 3], src, "x"))
    return spark.createDataFrame(data, "doc_id bigint, text string, source string, copies string")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("web", 0.4, 1), (" News", 0.3, 2), ("books", 0.3, 4), ("gone", 0.2, 3)], "source string, target_share double, max_repeats int")


def test_mixture_and_report_agree_and_keep_caps(spark, docs, targets):
    rows = mix.mixture(docs, targets).collect()
    again = mix.mixture(docs.repartition(7), targets).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    report = {r.source: r for r in mix.report(docs, targets).collect()}
    caps, use = {"web": 1, "news": 2, "books": 4}, {}
    for r in rows:
        use[r.doc_id, r.source] = use.get((r.doc_id, r.source), 0) + 1
        assert 1 <= r.copy_no <= caps[r.source]
    rate = {s: report[s].rate for s in caps}
    assert all(n in (math.floor(rate[s]), math.floor(rate[s]) + 1) and n <= caps[s] for (_, s), n in use.items())
    total = sum(r.n_tokens for r in rows)
    for s in caps:
        got = sum(r.n_tokens for r in rows if r.source == s)
        assert report[s].tokens_used == got and report[s].share_reached == pytest.approx(got / total) and abs(got / total - report[s].goal_share) < 0.05
    assert report["gone"].copies == 0 and report["gone"].goal_share == 0 and report["gone"].target_share == 0.2


def test_whole_rates_use_every_document_equally(spark, docs):
    t = spark.createDataFrame([("news", 1.0, 2)], "source string, target_share double, max_repeats int")
    rows = mix.mixture(docs, t).collect()
    assert len(rows) == 2 * docs.filter("source = 'news'").count()


def test_empty_tables(spark, docs, targets):
    assert mix.mixture(docs.filter("false"), targets).count() == 0 and mix.mixture(docs, targets.filter("false")).count() == 0
    assert mix.report(docs.filter("false"), targets).filter("share_reached = 0").count() == 4
