"""Fits the two models of text quality on texts judged by hand: ``python -m rillstone.llm.fit FOLDER [MOST]``.

FOLDER holds documents.parquet and doc_label.parquet; MOST (5,000 by default) bounds the labelled texts, taken in order of
a hash of their id. Labels are of texts and not of lines, so each model is fitted on the share of characters it gives to
running sentences. First the structure of lines is fitted on all texts but junk, a text of prose weighing ``STRICT`` times
as much as another, so that structure claims no prose; its weights may speak only against sentences. Then the ratios are
fitted on the texts that structure doesn't decide; the common words are held small by a penalty above that of the others.
"""

from __future__ import annotations

import sys

import numpy as np

from . import quality, signals

STRICT, SHARP, STEPS, RATE = 60.0, 16.0, 2000, 0.05
PENALTY, WORDS_PENALTY = 3e-4, 4e-3


def rows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per unit its structure, its ratios, its characters and the number of its text."""
    lines = [signals.lines_of(t) for t in texts]
    shape, aligned = quality.shapes(lines)
    paragraph = np.array([float(f in ("one", "wrapped")) for f in quality.STRUCTURE])
    built, said, size, of = [], [], [], []
    for n, (x, r, a) in enumerate(zip(lines, shape, aligned)):
        for i, k in quality.cut(x, a):
            built.append(r[i] if i == k else paragraph)
            said.append(quality.ratios(quality.joined(x, i, k)))
            size.append(sum(len(y.body) for y in x[i : k + 1]))
            of.append(n)
    return np.array(built), np.array(said), np.array(size, dtype=float), np.array(of)


def descend(x: np.ndarray, size: np.ndarray, of: np.ndarray, prose: np.ndarray, weight: np.ndarray, penalty: np.ndarray, open_: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Weights by Adam: the share of characters in sentences, sharpened around a half, against the labels."""
    n = len(prose)
    w = np.zeros(x.shape[1])
    w[0] = 1.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = np.maximum(np.bincount(of, size, n), 1.0)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        z = 1 / (1 + np.exp(-SHARP * (np.bincount(of, size * p * open_, n) / total - 0.5)))
        g = x.T @ (((z - prose) * weight * SHARP / n)[of] * size / total[of] * open_ * p * (1 - p)) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w[against] = np.minimum(w[against], 0.0)
    return w


def fit(labelled: list[tuple[str, str]]) -> tuple[dict[str, float], dict[str, float]]:
    """Weights of structure and of ratios from (kind, text)."""
    labelled = [(k, t) for k, t in labelled if t and t.strip()]
    kind = np.array([k for k, _ in labelled])
    built, said, size, of = rows_of([t for _, t in labelled])
    prose = (kind == "prose").astype(float)

    def among(keep: np.ndarray):
        return keep[of], (np.cumsum(keep) - 1)[of[keep[of]]]

    sel, at = among(kind != "junk")
    y = prose[kind != "junk"]
    against = np.array([f not in ("one", "wrapped") for f in quality.STRUCTURE])
    ws = descend(built[sel], size[sel], at, y, np.where(y == 1, STRICT, 1.0), np.full(built.shape[1], 1e-6), np.ones(len(at)), against)
    open_ = (built @ ws >= 0).astype(float)
    left = np.bincount(of, size * open_, len(kind)) >= 0.5 * np.bincount(of, size, len(kind))
    sel, at = among(left)
    y = prose[left]
    penalty = np.array([0.0 if f == "one" else WORDS_PENALTY if f in ("common", "bare_common") else PENALTY for f in quality.RATIOS])
    wr = descend(said[sel], size[sel], at, y, np.where(y == 1, 1.0, 1.5), penalty, open_[sel], np.zeros(said.shape[1], dtype=bool))
    return dict(zip(quality.STRUCTURE, ws.round(2).tolist())), dict(zip(quality.RATIOS, wr.round(2).tolist()))


def main(folder: str, most: int = 5000) -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.master("local[4]").getOrCreate()
    label, docs = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("doc_label", "documents"))
    rows = label.join(docs.select("doc_id", "text"), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("kind", "text").collect()
    for name, weights in zip(("STRUCTURE", "RATIOS"), fit([tuple(r) for r in rows])):
        print(name, weights)


if __name__ == "__main__":
    main(sys.argv[1], *map(int, sys.argv[2:3]))
