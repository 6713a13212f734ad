"""Statistics of a text's words, symbols and lines, and which texts are not natural prose.

Structure comes first: :mod:`signals` tells how the lines of a text stand to one another - delimiters above delimiters,
indentations that come back, lengths that correlate or leave lines ragged. A logistic model of those signals alone tells
the lines of tables and lists, whatever words they hold; nothing else is asked of them. Lines that fill the width they are
wrapped at are joined to paragraphs. What structure leaves, paragraphs and lines that stand for themselves, is running
sentences with a probability that a second logistic model gives from ratios of words, symbols, punctuation and common
words, none of which decides alone. A text is no prose if more than half of its characters lie outside running sentences,
each unit counted with its probability.

Both models were fitted by ``python -m rillstone.llm.fit``; their weights are fixed values here.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import signals
from .signals import BULLET, CJK, ENDS, Line

# Common words of the corpus' languages.
COMMON = {
    "en": "the a an and or but if of to in on at by for with from as is are was were be been has have had not no it its this that these those he she they we you i our your their his her who which what when where would could will can did do does than then so there more very because after before",
    "de": "der die das den dem des ein eine einer einem einen und oder aber wenn von zu in im an am auf bei für mit aus als ist sind war waren sein hat haben hatte nicht kein es dies er sie wir ihr ich unser wer was wo würde konnte wird nach vor über um mehr wie man dann sich auch dass damit",
    "fr": "le la les l un une des du de d et ou mais si à en dans sur par pour avec sans est sont était être a ont avait ne pas il elle nous vous je ce cette ces qui que qu où plus n s son sa ses leur notre votre après avant puis comme au aux parce depuis",
    "es": "el la los las un una unos y o pero si de del a al en por para con sin es son era ser ha han había no se su sus este esta lo que quien como más muy nunca ya nuestro nuestra cuando donde después antes desde luego porque aunque todavía",
    "ru": "и или но если в во на с со по из за о об от до у к для не ни это этот эта тот он она они мы вы я наш ваш что кто как где когда был была было были быть уже ещё больше чем после перед потому а его её их никто никогда то так про без самой давно все всё как бы ли же под над при",
}
WORDS = frozenset(w for v in COMMON.values() for w in v.split())
_CODE = re.compile(r"[{}<>=\\_@#$%^&*~|\[\]+/]")
_KANA = re.compile(r"[぀-ゟ]")
_DATE = re.compile(r"\d\.\d{1,2}\.\d{4}")
_LINK = re.compile(r"\(?\b\d{1,2}\.\d{1,2}\.\d{4},? ?|https?://[^\s)]+\)?")
_STRANGE = re.compile("[\x80-\x9f\ufffdÂ-ÅÐÑ]")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_CAPITAL = re.compile(r"(?<=\s)[A-ZÀ-ÞА-Я]")
_MIXED = re.compile(r"[^\W\d_]\d")
_STOPS = re.compile(r"[.!?](?=[\s\"”»)]|$)|[。！？、]")

#: Fitted values: weights of a line's structure; above 0 the line is left to the ratios, below it is a line of a table or list.
STRUCTURE = {
    "one": 5.99, "wrapped": 0.55, "aligned": -7.67, "aligned_around": -0.51, "lead": 0.0, "lead_around": -3.42, "indent_lags": -0.11, "ragged": -4.89, "ragged_around": 0.0, "length_lag_1": 0.0,
    "length_lags_2_3": -1.16, "even": -9.41,
}
#: Fitted values: weights of a unit's ratios, for running sentences.
RATIOS = {
    "one": -1.69, "length": 0.96, "short": -0.47, "stop": 1.78, "stop_length": 0.21, "stops": 2.22, "commas": -1.06, "commas_without_stop": -0.55, "symbols": -1.46, "code": 0.18, "digits": -0.09,
    "digit_words": -1.67, "letters_lacking": -0.99, "strange": -1.57, "word_length": -0.97, "repeated": -1.44, "capitals": -0.13, "cjk": -0.5, "kana": 0.44, "cjk_stop": 0.4, "common": 0.85, "bare_common": 0.55,
}


def wrapped_run(lines: list[Line], aligned: np.ndarray, i: int) -> tuple[int, int]:
    """The last line of the paragraph wrapped by hand that begins at line i, or i if none does; and the last line looked at.

    In such a paragraph no line had room for the first word of the next, at the width of its longest line; some line begins
    within a sentence. Lists and headlines fail on one of both.
    """
    a = lines[i]
    cjk = bool(CJK.search(a.body))
    width, room, k, inner = a.width, 10**9, i, False
    while k + 1 < len(lines) and aligned[k + 1] < 0.75:
        nxt = lines[k + 1]
        body = nxt.body
        if not body or nxt.indent or nxt.lead or sum(map(str.isalnum, body)) < 0.6 * len(body) or len(_CODE.findall(body)) > 0.08 * len(body):
            break
        fits = lines[k].width + (0 if cjk else 1) + nxt.first
        w, r = max(width, nxt.width), min(room, fits)
        if w >= r:
            break
        head = body.lstrip("\"'([«„“-")[:1]
        inner = inner or cjk or head.islower() or head.isdigit() or (body.isupper() and a.body.isupper())
        width, room, k = w, r, k + 1
    return (k if inner and (k - i >= 2 or k - i == 1 and lines[k].body[:1].islower()) else i), k


def ratios(text: str) -> list[float]:
    """Ratios of a unit's words, symbols and punctuation, in the order of ``RATIOS``."""
    text = text.strip()
    if "://" in text or _DATE.search(text):
        text = _LINK.sub(" ", text).strip()
    words = text.split()
    visible = sum(map(len, words))
    if not visible:
        return [1.0, -2.0, 1.0] + [0.0] * (len(RATIOS) - 3)
    ascii_ = text.isascii()
    known = _WORD.findall(text.lower())
    ascii_ = text.isascii()
    cjk = 0 if ascii_ else len(CJK.findall(text))
    east = float(cjk * 3 > visible)
    n = max(len(words), cjk / 2.5)
    letters = sum(map(len, known))
    digits = sum(map(len, _DIGITS.findall(text)))
    stop = float(text[-1] in ENDS)
    stops = len(_STOPS.findall(text))
    commas = min(1.0, 4 * (text.count(",") + text.count(";") + text.count("，")) / n)
    common = min(1.0, 4 * sum(map(WORDS.__contains__, known)) / n) if not east else 0.0
    length = math.log(n / 10)
    return [
        1.0, length, max(0.0, -length), stop, stop * max(0.0, length), min(1.0, 12 * stops / n), commas * stop, commas * (1 - stop),
        min(1.0, 4 * (visible - letters - digits) / visible), min(1.0, 10 * len(_CODE.findall(text)) / visible), min(1.0, 4 * digits / visible), min(1.0, 4 * len(_MIXED.findall(text)) / n) if digits else 0.0,
        max(0.0, 0.8 - letters / visible) / 0.8, 0.0 if ascii_ else min(1.0, 4 * len(_STRANGE.findall(text)) / visible), 0.0 if east else min(3.0, max(0.0, visible / len(words) - 8) / 4),
        max(0.0, math.log(0.5 * min(len(known), 120) / len(set(known)))) if known and not east else 0.0, len(_CAPITAL.findall(text)) / n, east, min(1.0, 2 * len(_KANA.findall(text)) / cjk) if east else 0.0,
        east * float(stop or stops > 0), common, common * (1 - stop),
    ]


def shapes(texts: list[list[Line]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per text the features of each line in the order of ``STRUCTURE``, and the alignment of each line; all texts at once."""
    gap = signals.AROUND + 1
    at, size = [], 0
    for lines in texts:
        at.append(size)
        size += len(lines) + gap
    aligned, lead, rag, wide, indent, there = (np.zeros(size) for _ in range(6))
    for i, lines in zip(at, texts):
        k = i + len(lines)
        aligned[i:k], lead[i:k], rag[i:k] = signals.alignment(lines), signals.leads(lines), signals.ragged(lines)
        wide[i:k], indent[i:k], there[i:k] = [x.width for x in lines], [x.indent for x in lines], 1.0
    seen = (wide > 0).astype(float)
    wide = np.log1p(wide)
    lags = signals.autocorrelations(wide, there)
    indents = signals.autocorrelations(indent, there).max(axis=0) * (signals.window_sums(indent, signals.AROUND) > 0)
    about = np.maximum(signals.window_sums(seen, signals.REACH), 1.0)
    mean = signals.window_sums(wide, signals.REACH) / about
    spread = np.sqrt(np.maximum(signals.window_sums(wide**2, signals.REACH) / about - mean**2, 0.0))
    even = np.maximum(0.0, 1 - 4 * spread) * (about > 3)
    around = [signals.window_sums(x, signals.REACH) / about for x in (aligned, lead, rag)]
    rows = np.vstack([np.ones(size), np.zeros(size), aligned, around[0], lead, around[1], indents, rag, around[2], lags[0], np.maximum(lags[1], lags[2]), even]).T
    return [rows[i : i + len(x)] for i, x in zip(at, texts)], [aligned[i : i + len(x)] for i, x in zip(at, texts)]


def cut(lines: list[Line], aligned: np.ndarray) -> list[tuple[int, int]]:
    """The units of a text, as first and last line: wrapped paragraphs, and the lines that are in none; blank lines are no units."""
    spans, i, tried = [], 0, 0
    while i < len(lines):
        if not lines[i].body:
            i += 1
            continue
        k = i
        if i >= tried and aligned[i] < 0.75:
            # lines of a run that was none don't begin another, so that the work stays linear
            k, tried = wrapped_run(lines, aligned, i)
        spans.append((i, k))
        i = k + 1
    return spans


def joined(lines: list[Line], i: int, k: int) -> str:
    return lines[i].body if i == k else ("" if CJK.search(lines[i].body) else " ").join(x.body for x in lines[i : k + 1])


def _structural(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,j->i", rows, np.array(list(STRUCTURE.values()))) < 0


def probability(rows: list[list[float]]) -> np.ndarray:
    """Of being running sentences, for the ratios of units."""
    z = np.einsum("ij,j->i", np.array(rows).reshape(len(rows), len(RATIOS)), np.array(list(RATIOS.values())))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def judged(texts: list[str]) -> list[list[tuple[str, str, float]]]:
    """Per text its units: what they are (table or list by structure, else prose or other by ratios), their text and their probability of being running sentences."""
    lines = [signals.lines_of(t) for t in texts]
    rows, aligned = shapes(lines)
    out, ask, asked = [], [], []
    for x, r, a in zip(lines, rows, aligned):
        units, built = [], _structural(r)
        for i, k in cut(x, a):
            if i == k and built[i]:
                units.append(("table" if a[i] >= 0.5 else "list", x[i].text, 0.0))
            else:
                asked.append((units, len(units), "\n".join(y.text for y in x[i : k + 1])))
                ask.append(ratios(joined(x, i, k)))
                units.append(None)
        out.append(units)
    for (units, at, text), p in zip(asked, probability(ask)):
        units[at] = ("prose" if p >= 0.5 else "other", text, float(p))
    return out


def units(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of each unit: table, list, prose or other; blank lines are none."""
    for kind, unit, _ in judged([text])[0]:
        yield kind, unit


def autocorrelation(lengths: list[int], lag: int) -> float:
    """Of the lengths of lines at a distance, between -1 and 1; 0 for too few lines, 1 for equal lengths."""
    return signals.correlation(lengths, lag)


def line_measures(text: str | None) -> dict[str, float]:
    """Of a whole text: lines, the largest autocorrelation of their lengths and of their indentations at lags 1 to 3, and lines that hold a delimiter as often as one of the three lines before or after."""
    if not text:
        return {"n_lines": 0, "line_autocorrelation": 0.0, "indent_period": 0.0, "delimited_lines": 0}
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    n = len(lines)
    counts = [[x.count(d) for d in signals.DELIMITERS] for x in lines]
    hit = [False] * n
    for i in range(n):
        for j in range(i + 1, min(n, i + 1 + signals.REACH)):
            if any(a and a == b for a, b in zip(counts[i], counts[j])):
                hit[i] = hit[j] = True
    indents = [len(x) - len(x.lstrip(" \t")) for x in lines]
    return {
        "n_lines": n,
        "line_autocorrelation": max(autocorrelation([len(x) for x in lines], lag) for lag in (1, 2, 3)),
        "indent_period": max(autocorrelation(indents, lag) for lag in (1, 2, 3)) if any(indents) else 0.0,
        "delimited_lines": sum(hit),
    }


def measures(texts: list[str | None]) -> list[dict[str, float]]:
    """Per text its characters and those of each kind of unit; of what structure leaves, ``prose`` and ``other`` by probability."""
    out = []
    for units_ in judged([t or "" for t in texts]):
        m = {"chars": 0, "prose": 0.0, "table": 0, "list": 0, "other": 0.0}
        for kind, unit, p in units_:
            size = len(unit.strip())
            m["chars"] += size
            if kind in ("table", "list"):
                m[kind] += size
            else:
                m["prose"] += size * p
                m["other"] += size * (1 - p)
        out.append(m)
    return out


def measure(text: str | None) -> dict[str, float]:
    """Characters by kind of unit and the measures of the lines of one text."""
    return {**measures([text])[0], **line_measures(text)}


def is_prose(m: dict[str, float]) -> bool:
    """Whether at least half of the characters are running sentences; texts without visible characters are not judged and count as prose."""
    return not m["chars"] or m["prose"] >= 0.5 * m["chars"]


_MEASURES = "chars bigint, prose_share double, table_share double, list_share double, is_prose boolean"
_LINES = "n_lines bigint, line_autocorrelation double, indent_period double, delimited_lines bigint"


def _measure_batches(id_col: str, text_col: str):
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = measures(batch.column(text_col).to_pylist())
            cols = [pa.array([m["chars"] for m in got], pa.int64())]
            for k in ("prose", "table", "list"):
                cols.append(pa.array([m[k] / m["chars"] if m["chars"] else 0.0 for m in got], pa.float64()))
            cols.append(pa.array([is_prose(m) for m in got], pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *cols], names=[id_col, *[c.split()[0] for c in _MEASURES.split(", ")]])

    return run


def _line_batches(id_col: str, text_col: str):
    def run(batches) -> Iterator:
        import pyarrow as pa

        names = [c.split()[0] for c in _LINES.split(", ")]
        types = [pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        for batch in batches:
            got = [line_measures(t) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *[pa.array([m[k] for m in got], t) for k, t in zip(names, types)]], names=[id_col, *names])

    return run


def structure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the shares of characters in sentences, tables and lists, and ``is_prose``; no shuffle. Null, empty and blank texts are prose of no characters."""
    return docs.select(id_col, text_col).mapInArrow(_measure_batches(id_col, text_col), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_MEASURES}")


def line_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row what :func:`line_measures` gives; no shuffle. Null and empty texts have no lines."""
    return docs.select(id_col, text_col).mapInArrow(_line_batches(id_col, text_col), f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {_LINES}")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row n_words, mean_word_length, symbol_ratio, punctuated_lines, common_words; all in the JVM.

    Words are what blanks, tabs and line ends separate; symbols are ASCII characters that are neither letters, digits nor
    white space. Null and empty texts have 0 words and null ratios.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    words: Column = F.filter(F.split(t, r"[ \t\r\n]+"), lambda w: w != "")
    rows = docs.select(id_col, t.alias("_t"), words.alias("_w"), F.filter(F.split(t, "[\r\n]+"), lambda x: F.regexp_replace(x, r"[ \t]", "") != "").alias("_l"))
    n, lines = F.size("_w"), F.size("_l")
    chars = F.length(F.regexp_replace("_t", r"[ \t\r\n]", ""))
    bare = F.transform("_w", lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()"))))
    return rows.select(
        id_col, n.cast("bigint").alias("n_words"), F.when(n > 0, chars / n).alias("mean_word_length"),
        F.when(chars > 0, F.length(F.regexp_replace("_t", r"[^!-/:-@\[-`{-~]", "")) / chars).alias("symbol_ratio"),
        F.when(lines > 0, F.size(F.filter("_l", lambda x: x.rlike(r"[.!?:;][ \t]*$"))) / lines).alias("punctuated_lines"),
        F.when(n > 0, F.size(F.filter(bare, lambda w: w.isin(*sorted(WORDS)))) / n).alias("common_words"),
    )
