"""How the lines of a text stand to one another: what shows tables and lists whatever words they hold.

Three signals, each of every line and between 0 and 1 (correlations between -1 and 1):

- *alignment*: delimiters above delimiters. Of the lines up to three above and below, the best agreement counts: the same
  number of a delimiter, the same skeleton (what is left of a line without its letters, numbers as one sign each), or
  columns that wide gaps begin in the same places. It fades with the words that a field holds, for sentences have as many
  commas as their neighbours by chance.
- *indentation*: how well indentations repeat at a distance of one to three lines, and whether a line begins with the
  same indentation and bullet or number as one of the three lines before or after it.
- *lengths*: the autocorrelation of line lengths around a line, at distances of one to three lines; and whether a line was
  left ragged, that is ended without a stop though the first word of the next line had room at the width of the lines
  around. Wrapped prose fills its lines, lists and headlines don't.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

#: Lines to either side that a line is compared with.
REACH = 3
#: Lines to either side over which lengths are correlated.
AROUND = 6
ENDS = frozenset(".!?:;…。！？\"”»)'")
BULLET = re.compile(r"\s*(?:([-*•·–—►▪◦+])|\(?\d{1,4}([.)])|[a-zA-Z]([.)]))\s+")
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_GAPS = re.compile(r"\S(?:\s{2,}|\t)(?=\S)")
_NUMBER = re.compile(r"\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
_NO_ASCII_LETTERS = dict.fromkeys(map(ord, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_AGAIN = re.compile(r"(.)\1+")
DELIMITERS = "|\t;,:>·/"


@dataclass(slots=True)
class Line:
    """A line and what comparing it needs."""

    text: str
    body: str
    width: int
    indent: int
    lead: str
    words: float
    first: int
    stop: bool
    counts: dict[str, int] = field(default_factory=dict)
    gaps: frozenset[int] = frozenset()
    kinds: frozenset[str] = frozenset()
    signs: str | None = None

    @property
    def skeleton(self) -> str:
        """See :func:`skeleton_of`; made when it is first asked for."""
        if self.signs is None:
            self.signs = skeleton_of(self.body)
        return self.signs


def skeleton_of(body: str) -> str:
    """What is left of a line without its letters and blanks: a sign for each number, one of each run of signs; a last stop doesn't count."""
    signs = body.translate(_NO_ASCII_LETTERS)
    if not signs.isascii():
        signs = _LETTERS.sub("", signs)
    return _AGAIN.sub(r"\1", "".join(_NUMBER.sub("9", signs).split())).rstrip(".!?。！？")


def line_of(text: str) -> Line:
    body = text.strip()
    wide = len(CJK.findall(body)) if not body.isascii() else 0
    split = body.split()
    bullet = BULLET.match(text)
    lead = next((g for g in bullet.groups() if g), "") if bullet else ""
    indent = len(text) - len(text.lstrip())
    counts = {d: n for d in DELIMITERS if (n := text.count(d))}
    gaps = frozenset(m.end() for m in _GAPS.finditer(text)) if "  " in text or "\t" in text else frozenset()
    first = 2 if wide and CJK.match(body) else len(split[0]) if split else 0
    return Line(text, body, len(body) + wide, indent, f"{indent}{lead}" if indent or lead else "", max(len(split), wide / 2.5), first, body[-1:] in ENDS, counts, gaps, frozenset(counts) - {"\t"})


def lines_of(text: str) -> list[Line]:
    return [line_of(x) for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n")]


def agreement(a: Line, b: Line) -> float:
    """How well the delimiters of two lines stand above one another."""
    best, words = 0.0, (a.words + b.words) / 2
    for d, n in a.counts.items():
        if b.counts.get(d) == n:
            best = max(best, min(1.0, 2 / (1 + words / (n + 1))) * (1.0 if n > 1 else 0.75))
    # lines of one skeleton have the same kinds of delimiters, tabs aside
    if best < 1.0 and a.kinds == b.kinds and a.skeleton and a.skeleton == b.skeleton:
        best = max(best, min(1.0, 2 / (1 + words / len(a.skeleton))))
    if a.gaps and b.gaps:
        best = max(best, len(a.gaps & b.gaps) / min(len(a.gaps), len(b.gaps)))
    return best


def alignment(lines: list[Line]) -> np.ndarray:
    """Per line its best agreement with a line nearby."""
    out = np.zeros(len(lines))
    for i, a in enumerate(lines):
        for j in range(i + 1, min(i + 1 + REACH, len(lines))):
            s = agreement(a, lines[j])
            if s > out[i]:
                out[i] = s
            if s > out[j]:
                out[j] = s
    return out


def leads(lines: list[Line]) -> np.ndarray:
    """Per line whether it begins like a line nearby, with indentation, bullet or number."""
    out = np.zeros(len(lines))
    for i, a in enumerate(lines):
        if a.lead:
            for j in range(i + 1, min(i + 1 + REACH, len(lines))):
                if lines[j].lead == a.lead:
                    out[i] = out[j] = 1.0
                    break
    return out


def window_sums(x: np.ndarray, reach: int) -> np.ndarray:
    """Sums of x over the places up to ``reach`` to either side."""
    c = np.r_[0.0, np.cumsum(x)]
    n = len(x)
    at = np.arange(n)
    return c[np.minimum(at + reach + 1, n)] - c[np.maximum(at - reach, 0)]


def autocorrelations(values: np.ndarray, there: np.ndarray, reach: int = AROUND) -> np.ndarray:
    """Per place the autocorrelation of the values around it at lags 1, 2 and 3 (three rows); 1 where they don't vary, 0 where there are too few.

    ``there`` is 1 where a place holds a value and 0 in the gap, at least ``reach`` wide, that parts the values of two texts.
    """
    n = len(values)
    out = np.zeros((3, n))
    values = values * there
    m = np.maximum(window_sums(there, reach), 1.0)
    mean = window_sums(values, reach) / m
    var = window_sums(values**2, reach) / m - mean**2
    few, flat = m < 4, var < 1e-9
    for lag in (1, 2, 3):
        pair, both, left, right = (np.zeros(n) for _ in range(4))
        if n > lag:
            both[:-lag] = there[:-lag] * there[lag:]
            pair[:-lag], left[:-lag], right[:-lag] = values[:-lag] * values[lag:], values[:-lag] * there[lag:], values[lag:] * there[:-lag]
        k = window_sums(both, reach)
        cov = window_sums(pair, reach) - mean * (window_sums(left, reach) + window_sums(right, reach)) + mean**2 * k
        with np.errstate(divide="ignore", invalid="ignore"):
            out[lag - 1] = np.where(few, 0.0, np.where(flat, 1.0, np.where(k > 0, cov / np.maximum(k, 1.0) / var, 0.0)))
    return np.clip(out, -1.0, 1.0)


def ragged(lines: list[Line]) -> np.ndarray:
    """Per line whether it ended without a stop though the next line's first word had room at the width of the widest line around; the last line of a text is judged like the one before."""
    n = len(lines)
    out = np.zeros(n)
    for i, a in enumerate(lines):
        if not a.width or a.stop:
            continue
        near = lines[max(0, i - REACH) : i + REACH + 1]
        room = max(x.width for x in near)
        nxt = next((x for x in lines[i + 1 : i + 2] if x.width), None)
        if nxt is None:
            out[i] = out[i - 1] if i and lines[i - 1].width else 0.0
        elif a.width + 1 + nxt.first <= room:
            out[i] = 1.0
    return out


def correlation(values: list[int], lag: int) -> float:
    """Autocorrelation of all values at a lag, between -1 and 1; 0 for too few values, 1 for equal ones. Whole numbers until the division, so that it is the same whoever computes it."""
    n = len(values)
    if n <= lag + 1:
        return 0.0
    total = sum(values)
    var = sum((n * x - total) ** 2 for x in values)
    if not var:
        return 1.0
    return float(sum((n * values[i] - total) * (n * values[i + lag] - total) for i in range(n - lag))) / float(var)
