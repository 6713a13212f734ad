"""Running values over a global order without a window that falls to one task.

The order is cut into chunks (see :mod:`skew`), as many as the rows need. Inside a chunk an ordinary window runs; what the
chunks before add (a maximum, a sum, a count, the last value) is one row per chunk, scanned on its own and joined back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import chunk_number, chunks

#: Rows that one window task may hold.
CHUNK_ROWS = 2_000_000


def cuts_of(df: DataFrame, order: str | list[str], chunk_rows: int = CHUNK_ROWS) -> list:
    """Cuts at which chunks of the order end, none if the rows fit one. The cuts serve every scan over the same order."""
    order = [order] if isinstance(order, str) else order
    return chunks(df, order, math.ceil(df.count() / chunk_rows))


def running(df: DataFrame, order: list[str], adds: dict[str, tuple[str, Column | None]], *, by: tuple[str, ...] = (), cuts: list | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with running columns over the rows in ``order`` (a total order of numeric columns, the first not null).

    Kinds: ``row`` (number from 1), ``sum`` and ``max`` up to and with the row, ``max_before`` up to the row before it,
    ``lag`` (value of the row before). No rows give no rows. ``by``: columns (not null) each of whose values has an order of
    its own, which may be as long as all rows. ``cuts``: from :func:`cuts_of`, found anew if not given.
    """
    cuts = cuts_of(df, order, chunk_rows) if cuts is None else cuts
    df, many = df.withColumn("_chunk", chunk_number(order, cuts)), bool(cuts)
    w = Window.partitionBy(*by, "_chunk").orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    local = {
        "row": lambda e: F.row_number().over(w).cast("bigint"), "sum": lambda e: F.sum(e).over(upto), "max": lambda e: F.max(e).over(upto),
        "max_before": lambda e: F.max(e).over(before), "lag": lambda e: F.lag(F.struct(e.alias("v"))).over(w),
    }
    out = df.withColumns({f"_l_{n}": local[k](e) for n, (k, e) in adds.items()})
    total = {"row": lambda e: F.count(F.lit(1)), "sum": lambda e: F.sum(e), "max": lambda e: F.max(e), "max_before": lambda e: F.max(e), "lag": lambda e: F.max_by(F.struct(e.alias("v")), F.struct(*order))}
    if many:
        per = df.groupBy(*by, "_chunk").agg(*[total[k](e).alias(f"_t_{n}") for n, (k, e) in adds.items()])
        wc = Window.partitionBy(*by).orderBy("_chunk") if by else Window.orderBy("_chunk")  # one row per chunk
        prior = wc.rowsBetween(Window.unboundedPreceding, -1)
        fold = {"row": F.sum, "sum": F.sum, "max": F.max, "max_before": F.max}
        carry = per.select(*by, "_chunk", *[(F.lag(f"_t_{n}").over(wc) if k == "lag" else fold[k](f"_t_{n}").over(prior)).alias(f"_c_{n}") for n, (k, _) in adds.items()])
        out = out.join(carry, [*by, "_chunk"])
    final = {}
    for n, (k, _) in adds.items():
        l, c = F.col(f"_l_{n}"), F.col(f"_c_{n}") if many else None
        if k == "lag":
            final[n] = (F.coalesce(l, c) if many else l).getField("v")
        elif not many:
            final[n] = l
        elif k in ("row", "sum"):
            final[n] = F.coalesce(l + c, l, c)
        else:
            final[n] = F.greatest(l, c)
    return out.withColumns(final).drop("_chunk", *[f"_l_{n}" for n in adds], *([f"_c_{n}" for n in adds] if many else []))
