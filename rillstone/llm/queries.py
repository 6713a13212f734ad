"""The text queries (p8 to p10) over the test tables, with their reference SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import load
from . import encode, mix, quality


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every text by byte_bpe_50k."""
    return encode.encode_corpus(load(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixture, one row per copy of a document."""
    return mix.mixture(load(spark, d, "documents"), load(spark, d, "mix_target"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares asked for and reached."""
    return mix.report(load(spark, d, "documents"), load(spark, d, "mix_target"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that aren't natural prose."""
    return quality.structure(load(spark, d, "documents")).filter(~F.col("is_prose")).select("doc_id")


def p10_structure(spark: SparkSession, d: str) -> DataFrame:
    """Shares of sentences, tables and lists in every text."""
    return quality.structure(load(spark, d, "documents"))


def p10_signals(spark: SparkSession, d: str) -> DataFrame:
    """Autocorrelations of lengths and indentations and lines with common delimiters, of every text."""
    return quality.line_signals(load(spark, d, "documents"))


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    """Word, symbol and line statistics of every text."""
    return quality.statistics(load(spark, d, "documents"))


_KNOWN = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(quality.WORDS))
P10_STATS_SQL = rf"""
with t as (select doc_id, coalesce(text, '') t from documents),
  s as (select doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\r\n]+'), lambda w: w <> '') w, list_filter(regexp_split_to_array(t, '[\r\n]+'), lambda x: regexp_replace(x, '[ \t]', '', 'g') <> '') l, length(regexp_replace(t, '[ \t\r\n]', '', 'g')) c from t)
select doc_id, len(w) as n_words, case when len(w) > 0 then c / len(w) end as mean_word_length,
  case when c > 0 then length(regexp_replace(t, '[^!-/:-@\[-`{{-~]', '', 'g')) / c end as symbol_ratio,
  case when len(l) > 0 then len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;][ \t]*$'))) / len(l) end as punctuated_lines,
  case when len(w) > 0 then len(list_filter(w, lambda x: lower(regexp_replace(x, '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g')) in ({_KNOWN}))) / len(w) end as common_words
from s"""

_CORRELATION = "case when n <= {lag} + 1 then 0.0 when list_max({v}) = list_min({v}) then 1.0 else cast(list_sum(list_transform(range(1, n - {lag} + 1), lambda i: cast(n * {v}[i] - {s} as hugeint) * (n * {v}[i + {lag}] - {s}))) as double) / cast(list_sum(list_transform({v}, lambda x: cast(n * x - {s} as hugeint) * (n * x - {s}))) as double) end"
_HIGHEST = "greatest(" + ", ".join(_CORRELATION.replace("{lag}", str(k)) for k in (1, 2, 3)) + ")"
P10_SIGNALS_SQL = rf"""
with t as (select doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) x from documents where text <> ''),
  l as (select doc_id, x, len(x) n, list_transform(x, lambda y: length(y)) v, list_transform(x, lambda y: length(y) - length(ltrim(y, ' ' || chr(9)))) w,
    list_transform(x, lambda y: list_transform(['|', chr(9), ';', ',', ':', '>', '·', '/'], lambda d: length(y) - length(replace(y, d, '')))) c from t),
  s as (select *, list_sum(v) sv, list_sum(w) sw from l),
  h as (select doc_id, len(list_filter(range(1, n + 1), lambda i: len(list_filter(range(greatest(1, i - 3), least(n, i + 3) + 1), lambda j: j <> i and len(list_filter(range(1, 9), lambda k: c[i][k] > 0 and c[i][k] = c[j][k])) > 0)) > 0)) k from s)
select doc_id, n as n_lines, {_HIGHEST.format(v="v", s="sv")} as line_autocorrelation, case when sw > 0 then {_HIGHEST.format(v="w", s="sw")} else 0.0 end as indent_period, k as delimited_lines from s join h using (doc_id)
union all select doc_id, 0, 0.0, 0.0, 0 from documents where text is null or text = ''"""

QUERIES = {f.__name__: f for f in (p8_ids, p9_mix, p9_shares, p10_found, p10_structure, p10_signals, p10_stats)}
ORACLE = {"p10_signals": P10_SIGNALS_SQL, "p10_stats": P10_STATS_SQL}
