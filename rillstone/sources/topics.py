"""Which topics there are, and what their tables are called."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def available(topics: DataFrame, col: str, prefix: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Topics to capture: those listed if any are, else those with the prefix that aren't excluded and whose rest has a namespace."""
    c = F.col(col)
    if include:
        return topics.filter(c.isin(*include))
    rest = F.substring(c, len(prefix) + 1, 10_000)
    keep = c.startswith(prefix) & rest.contains(".")
    return topics.filter(keep & ~c.isin(*exclude) if exclude else keep)


def table_id(topic: Column, prefix: str) -> tuple[Column, Column]:
    """Namespace (dotted) and name of a topic's table: the rest after the prefix, its last part being the name; null if there are less than two parts."""
    rest = F.when(topic.startswith(prefix), topic.substr(F.lit(len(prefix) + 1), F.length(topic))).otherwise(topic)
    parts = F.split(F.regexp_replace(rest, r"^\.+", ""), r"\.")
    ok = F.size(parts) >= 2
    return F.when(ok, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")), F.when(ok, F.element_at(parts, -1))


class Adjuster:
    """Changes names of tables; the base changes nothing."""

    def namespace(self, c: Column) -> Column:
        return c

    def table(self, c: Column) -> Column:
        return c

    def column(self, c: Column) -> Column:
        return c


class ChangeCase(Adjuster):
    """Upper or lower case for each of namespace, table and column; None leaves it."""

    def __init__(self, namespace: str | None = None, table: str | None = None, column: str | None = None):
        fn: dict[str | None, Callable[[Column], Column]] = {"upper": F.upper, "lower": F.lower, None: lambda c: c}
        self.namespace, self.table, self.column = fn[namespace], fn[table], fn[column]


class MapNamespaces(Adjuster):
    """Other names for whole namespaces; those not listed stay."""

    def __init__(self, mapping: dict[str, str]):
        self.mapping = mapping

    def namespace(self, c: Column) -> Column:
        if not self.mapping:
            return c
        m = F.create_map(*[F.lit(x) for kv in sorted(self.mapping.items()) for x in kv])
        return F.coalesce(F.element_at(m, c), c)


class Chain(Adjuster):
    """Adjusters one after the other, each on what the one before left."""

    def __init__(self, *steps: Adjuster):
        self.steps = steps

    def namespace(self, c: Column) -> Column:
        for s in self.steps:
            c = s.namespace(c)
        return c

    def table(self, c: Column) -> Column:
        for s in self.steps:
            c = s.table(c)
        return c

    def column(self, c: Column) -> Column:
        for s in self.steps:
            c = s.column(c)
        return c
