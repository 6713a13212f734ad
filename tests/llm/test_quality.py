import time
from pathlib import Path

import pytest

from rillstone.llm import quality

EN = "Every quiet gardener had never repaired the last window, and our teacher would rather write about the long way home than look after a box of tiles."
PROSE = {
    "sentence": EN,
    "lower without stops": "the old teacher would never forget the long way home because the rain had been with them for more than twelve years and nobody could say what was left",
    "wrapped": "Our quiet newspaper could not\ncarry any of the 40 boats because\nof the rain. The northern ferry\nwanted to open the garden wall as\nif it had always been there\nalthough the little workshop had\nnever noticed more than it could\nhold at the end of the pier.",
    "upper": EN.upper() + " " + EN.upper(),
    "de": "Der kleine Lehrer würde nie auf den Regen warten, damit unser Hafen in der Nähe des Bahnhofs über die Geschichte berichten konnte.",
    "fr": "Une grande forêt n'a jamais attendu l'été dernier depuis plus de 12 ans, mais notre port aurait rêvé de la pluie après l'orage.",
    "es": "El viejo molino nunca ha soñado con los niños después de la tormenta, porque una biblioteca siempre ha cuidado en el camino.",
    "ru": "Наш мост давно не рассказывал о дожде после грозы, и наш мост никогда не вспоминал о дожде без лишних слов.",
    "ja": "小さな先生は駅の近くで古い手紙をずっと待っていて、しかし古い庭は残されたものをずっと待っていました。",
    "damaged": EN.replace("quiet", "qui�t").replace("teacher", "te�cher"),
    "with a short menu": "Home\nNews\nContact\n" + EN,
    "link inside": EN + " (12.4.2011, https://p0.example/1699)",
}
OTHER = {
    "bullets": "\n".join(f"- blue oak shelf number {i}" for i in range(12)),
    "plain list": "\n".join(f"{a} {b}" for a in ("blue", "small", "heavy") for b in ("map", "tin whistle", "ladder", "rope")),
    "enumeration": "blue map x15, heavy seed tray, small tin whistle, vintage oak shelf x3, waterproof seed tray, blue oak shelf, vintage rope",
    "headlines": "\n".join(f"The {a} {b} at the end of the pier" for a in ("famous", "quiet") for b in ("museum", "bakery", "harbour")),
    "pipes": "\n".join(f"| {i} | kettle | {i * 3.5} |" for i in range(9)),
    "tabs": "\n".join(f"kettle\t{i}\t2025-01-0{i}" for i in range(1, 9)),
    "columns": "\n".join(f"{'lamp':<14}{i:<14}rope" for i in range(9)),
    "csv": "\n".join(f"lamp,{i},rope,{i * 2}" for i in range(9)),
    "keys": "\n".join(f"{k}: {v}" for k, v in zip(["lamp", "rope", "map", "kettle", "wool"] * 2, range(10))),
    "code": "\n".join(f"var q{i}=function(a,b){{return a[{i}]||b.c{i};}};" for i in range(8)),
    "log": "\n".join(f"2025-06-24T21:41:5{i} WARN [w-{i}] code=15{i} ref=0xa34157d8" for i in range(9)),
    "base64": "8AgJuXSMUkCaYcdPqB36uwDMudqj8dO3gSps1Cd8r3vPVntLusKnAX" * 6,
    "symbols": "\n".join("*" * 40 for _ in range(6)),
    "repeated": "lamp " * 80,
    "repeated common words": "the of and to " * 60,
    "random": "gljkzaxel wnxopxvgnx idou qptcnrxzhdbbp tdgwzindwcxhk mxfamsekimubo zb crbwshbztij kw pgrwagjhodp srdw",
    "wrong charset": "Наш мост уже думал про старые письма без лишних слов.".encode().decode("latin-1"),
    "links": "\n".join(f"https://h{i}.example/cat/{i * 7919}" for i in range(9)),
}


@pytest.mark.parametrize("name", PROSE)
def test_prose(name):
    assert quality.is_prose(quality.measure(PROSE[name])), list(quality.units(PROSE[name]))


@pytest.mark.parametrize("name", OTHER)
def test_other(name):
    assert not quality.is_prose(quality.measure(OTHER[name])), list(quality.units(OTHER[name]))


def test_the_larger_half_decides():
    assert quality.is_prose(quality.measure(EN + "\n" + "*" * 40)) and not quality.is_prose(quality.measure(EN + "\n" + ("*" * 40 + "\n") * 9))


def test_autocorrelation():
    assert quality.autocorrelation([1, 9] * 20, 2) > 0.8 > 0 > quality.autocorrelation([1, 9] * 20, 1)
    assert quality.autocorrelation([5] * 9, 1) == 1.0 and quality.autocorrelation([1], 1) == 0.0


def test_nulls_blanks_and_repeats(spark, rows):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n\t", 1), (4, OTHER["log"], 1), (4, OTHER["log"], 1), (None, EN, 1)], "doc_id bigint, text string, chars int")
    got = quality.structure(df).collect()
    assert {(r.doc_id, r.is_prose) for r in got} == {(1, True), (2, True), (3, True), (4, False), (None, True)} and len(got) == 6
    s = {r.doc_id: r for r in quality.statistics(df).collect()}
    assert s[1].n_words == 0 and s[1].mean_word_length is None and s[3].symbol_ratio is None and s[None].punctuated_lines == 1.0 and s[None].common_words == pytest.approx(10 / 27)
    assert quality.structure(df.filter("false")).count() == 0 and quality.statistics(df.filter("false")).count() == 0


@pytest.mark.parametrize("text", ["A" * 40 + "\n", "word " * 40 + "\n", "\n", "a;b;c\n", "x" * 1000, "  "], ids=repr)
def test_long_texts_take_linear_time(text):
    took = []
    for n in (1, 4):
        t = time.process_time()
        quality.measure(text * (n * 200_000 // len(text)))
        took.append(time.process_time() - t)
    assert took[1] < 12 * max(took[0], 0.05)


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_agrees_with_the_labels():
    import duckdb

    d = "/root/testdata/sf0.1"
    got = duckdb.sql(f"select kind, text from '{d}/doc_label.parquet' join '{d}/documents.parquet' using (doc_id)").fetchall()
    right = sum(quality.is_prose(quality.measure(t)) == (k == "prose") for k, t in got)
    assert len(got) > 100 and right >= 0.98 * len(got)


@pytest.mark.parametrize("name", ["bullets", "pipes", "tabs", "columns", "csv", "keys", "log"])
def test_structure_tells_tables_and_lists_before_any_word_is_looked_at(monkeypatch, name):
    monkeypatch.setitem(quality.RATIOS, "one", 100.0)  # whatever is left to the ratios is prose
    m = quality.measure(OTHER[name])
    assert m["table"] + m["list"] > 0.5 * m["chars"] and not quality.is_prose(m)


@pytest.mark.parametrize("name", [k for k in PROSE if k != "ja"])
def test_structure_leaves_prose_alone(name):
    m = quality.measure(PROSE[name])
    assert m["table"] + m["list"] < 0.5 * m["chars"]


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no test tables")
def test_common_words_are_one_ratio_among_several(monkeypatch):
    import duckdb

    monkeypatch.setattr(quality, "WORDS", frozenset())
    d = "/root/testdata/sf0.1"
    got = duckdb.sql(f"select kind, text from '{d}/doc_label.parquet' join '{d}/documents.parquet' using (doc_id)").fetchall()
    right = sum(quality.is_prose(quality.measure(t)) == (k == "prose") for k, t in got)
    assert right >= 0.95 * len(got)


def test_fit_tells_lists_from_prose():
    from rillstone.llm.fit import fit

    structure, ratios = fit([("prose", EN), ("prose", PROSE["de"]), ("list", OTHER["plain list"]), ("table", OTHER["tabs"]), ("junk", OTHER["base64"])] * 4)
    assert set(structure) == set(quality.STRUCTURE) and set(ratios) == set(quality.RATIOS)
    assert all(v <= 0 for k, v in structure.items() if k not in ("one", "wrapped")) and ratios["stop"] > 0
