"""Mixing sources to target weights.

Tokens are counted once per document and summed per source. The size of the mixture is as large as every source allows
with no document used more often than its cap; each source's repetition rate is its share of that size over its tokens.
A document is emitted floor(rate) times, and once more if a hash of its id, as a number between 0 and 1, is below the
fraction: a Bernoulli copy that any retry draws alike. Emitting is a map over documents, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .encode import count_tokens
from .tokens import FOLDER


@dataclass(frozen=True)
class Share:
    """A source of the mixture: the share asked for, the share it can have, and how often its documents are used."""

    source: str
    target: float
    goal: float
    cap: int
    docs: int
    tokens: int
    rate: float


def source_name(col: str) -> Column:
    """A source's name without outer blanks, in lower case."""
    return F.lower(F.trim(F.col(col)))


def plan(targets: list[tuple[str, float, int]], supply: dict[str, tuple[int, int]], total: float | None = None) -> list[Share]:
    """Rates of all sources of ``targets`` (source, share, cap) over ``supply`` (documents, tokens).

    Sources without tokens can have no share; those of the others are raised in proportion. ``total``: tokens wanted; more
    than the caps allow is lowered to what they allow.
    """
    merged: dict[str, tuple[float, int]] = {}
    for s, share, cap in targets:
        if s is not None:
            old = merged.get(s)
            merged[s] = ((old[0] if old else 0.0) + (share or 0.0), min(old[1], cap or 0) if old else cap or 0)
    able = {s for s, (share, cap) in merged.items() if share > 0 and cap > 0 and supply.get(s, (0, 0))[1] > 0}
    whole = sum(merged[s][0] for s in able)
    most = min((merged[s][1] * supply[s][1] * whole / merged[s][0] for s in able), default=0.0)
    size = most if total is None else min(total, most)
    out = []
    for s, (share, cap) in sorted(merged.items()):
        docs, tokens = supply.get(s, (0, 0))
        goal = share / whole if s in able else 0.0
        rate = min(round(size * goal / tokens, 12), float(cap)) if s in able else 0.0
        out.append(Share(s, share, goal, cap, docs, tokens, rate))
    return out


def copies(rate: Column, key: Column, seed: int) -> Column:
    """How often a document is used: floor(rate), and once more with the probability of the fraction."""
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2**53)) / F.lit(float(2**53))
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def counted(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(id, source, n_tokens) of every document, written to the shared folder, for it is read twice and tokenizing is dear."""
    rows = docs.select(id_col, source_name(source_col).alias("source"), text_col)
    return materialise(count_tokens(rows, [id_col, "source"], text_col, vocabulary=vocabulary, folder=folder), "token-counts")


def shares(tokens: DataFrame, targets: DataFrame, total: float | None = None) -> list[Share]:
    """The plan for counted documents; on the driver are as many rows as there are targets."""
    named = targets.select(source_name("source").alias("source"), "target_share", "max_repeats")
    goal = [(r.source, r.target_share, r.max_repeats) for r in named.collect()]
    listed = named.select("source").distinct()
    supply = tokens.join(listed, "source", "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    return plan(goal, {r.source: (r.docs, r.tokens) for r in supply.collect()}, total)


def emit(tokens: DataFrame, sources: list[Share], id_col: str = "doc_id", *, seed: int = 42) -> DataFrame:
    """Per document of the mixture its ``copies``: id, source, n_tokens, copies. Documents of no source, of an unlisted one or drawn no times are left out."""
    used = [s for s in sources if s.rate > 0]
    if not used:
        return tokens.select(id_col, "source", "n_tokens", F.lit(0).alias("copies")).filter("false")
    rate = F.element_at(F.create_map(*[x for s in used for x in (F.lit(s.source), F.lit(s.rate))]), F.col("source"))
    return tokens.filter(F.col("source").isin(*[s.source for s in used])).select(id_col, "source", "n_tokens", copies(rate, F.col(id_col), seed).alias("copies")).filter("copies > 0")


def mixture(docs: DataFrame, targets: DataFrame, *, seed: int = 42, total: float | None = None, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """The mixture, one row per copy: doc_id, source, n_tokens, copy_no from 1."""
    tokens = counted(docs, vocabulary=vocabulary, folder=folder)
    got = emit(tokens, shares(tokens, targets, total), seed=seed)
    return got.select("doc_id", "source", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"))


def report(docs: DataFrame, targets: DataFrame, *, seed: int = 42, total: float | None = None, vocabulary: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """Per listed source the share asked for, the share it can have and the share reached, with documents, tokens and copies."""
    tokens = counted(docs, vocabulary=vocabulary, folder=folder)
    plan_ = shares(tokens, targets, total)
    used = emit(tokens, plan_, seed=seed).groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens_used"))
    got = {r.source: (r.copies, r.tokens_used) for r in used.collect()}  # as many rows as there are targets
    whole = math.fsum(t for _, t in got.values())
    rows = [(s.source, s.target, s.goal, s.cap, s.docs, s.tokens, s.rate, *got.get(s.source, (0, 0)), got.get(s.source, (0, 0))[1] / whole if whole else 0.0) for s in plan_]
    return tokens.sparkSession.createDataFrame(rows, "source string, target_share double, goal_share double, max_repeats int, docs bigint, tokens bigint, rate double, copies bigint, tokens_used bigint, share_reached double")
