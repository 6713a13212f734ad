"""Differences between two copies of a dataset by characteristic-polynomial set reconciliation.

Rows are hashed into the field of the prime 2^61 - 1 and spread over buckets. Each side alone reduces a bucket to its
size and to the values of its characteristic polynomial, prod (z - h), at a number of public points: a sketch whose size
depends on the degree bound and not on the rows. The quotient of both sides' values is a rational function whose
numerator has the rows of one side only as its roots and whose denominator those of the other. It is interpolated from
as many points as the bound, and verified at further points. The bound doubles until every bucket is verified: a bucket is
tried first at the bound that the difference of its sizes asks for, and where one side has no rows all rows of the other
are its roots. Only rows whose hashes are roots are then fetched from either side and compared field by field.

A bucket holds few rows whatever the tables hold, and interpolating takes the square of its bound, so that the work grows
with the rows and no faster with the rows that differ.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

P = 2**61 - 1
#: Points beyond the bound at which an interpolation is verified.
CHECKS = 3


def points(n: int) -> list[int]:
    """The first ``n`` public points, the same on both sides; all are from 2^60 on and hashes are below, so that no row can fall on a point."""
    return [2**60 + (0x9E3779B97F4A7C15 * (i + 1)) % (2**60 - 1) for i in range(n)]


def mulmod(a, b):
    """a * b mod 2^61 - 1 for numpy arrays of uint64 below the prime, by 32-bit halves."""
    import numpy as np

    lo, hi, p = np.uint64(0xFFFFFFFF), np.uint64(32), np.uint64(P)
    a0, a1, b0, b1 = a & lo, a >> hi, b & lo, b >> hi
    mid = a1 * b0 + a0 * b1  # below 2^62
    low = a0 * b0
    # a*b = a1*b1*2^64 + mid*2^32 + low, and 2^61 = 1
    out = (a1 * b1 << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & np.uint64(2**29 - 1)) << hi)
    out = (out & p) + (out >> np.uint64(61)) + (low & p) + (low >> np.uint64(61))
    out = (out & p) + (out >> np.uint64(61))
    return np.where(out >= p, out - p, out)


def _sketch(n_points: int):
    """Per batch of rows sorted by bucket: size and polynomial values of each bucket; a bucket that goes on in the next batch is carried over."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        zs = np.array(points(n_points), dtype=np.uint64)
        p = np.uint64(P)

        def emit(buckets, sizes, values):
            flat = pa.array(values.reshape(-1).astype(np.int64))
            lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, n_points, dtype=np.int32), flat)
            return pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(sizes), lists], names=["bucket", "size", "values"])

        open_bucket, open_size, open_value = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, h = batch.column("bucket").to_numpy(), batch.column("h").to_numpy().astype(np.uint64)
            value = zs[None, :] + (p - h)[:, None]
            value = np.where(value >= p, value - p, value)
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            sizes = np.diff(np.r_[starts, len(bucket)])
            # products of segments, halving the longest each time
            names = bucket[starts]
            while len(value) > len(starts):
                n = np.diff(np.r_[starts, len(value)])
                place = np.arange(len(value)) - np.repeat(starts, n)
                left = np.flatnonzero(place % 2 == 0)
                has = place[left] + 1 < np.repeat(n, n)[left]
                merged = value[left]
                merged[has] = mulmod(merged[has], value[left[has] + 1])
                value = merged
                starts = np.r_[0, np.cumsum((n + 1) // 2)[:-1]]
            if open_bucket is not None:
                if names[0] == open_bucket:
                    value[0] = mulmod(value[0], open_value)
                    sizes[0] += open_size
                else:
                    yield emit(np.array([open_bucket]), np.array([open_size]), open_value[None, :])
            if len(names) > 1:
                yield emit(names[:-1], sizes[:-1], value[:-1])
            open_bucket, open_size, open_value = names[-1], sizes[-1], value[-1]
        if open_bucket is not None:
            yield emit(np.array([open_bucket]), np.array([open_size]), open_value[None, :])

    return run


def sketches(rows: DataFrame, n_points: int) -> DataFrame:
    """(bucket, size, values) of one side's (bucket, h); as many tasks as the session's shuffles have, so that few open buckets are spread too."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket").mapInArrow(_sketch(n_points), "bucket bigint, size bigint, values array<bigint>")


def _times(a: list[int], b: list[int]) -> list[int]:
    """Product of two polynomials, constant first."""
    out = [0] * (len(a) + len(b) - 1)
    for i, x in enumerate(a):
        if x:
            for k, y in enumerate(b):
                out[i + k] += x * y
    return [x % P for x in out]


def _trim(a: list[int]) -> list[int]:
    while a and not a[-1]:
        a.pop()
    return a


def _divide(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and remainder of polynomials, constant first, ``b`` without leading zeros."""
    a, inv, quotient = a[:], pow(b[-1], -1, P), [0] * max(0, len(a) - len(b) + 1)
    for i in range(len(a) - len(b), -1, -1):
        q = quotient[i] = a[i + len(b) - 1] * inv % P
        if q:
            for k, y in enumerate(b):
                a[i + k] = (a[i + k] - q * y) % P
    return quotient, _trim(a[: len(b) - 1])


@functools.lru_cache(maxsize=8)
def _basis(n: int) -> tuple[list[int], list[list[int]]]:
    """The polynomial with the first ``n`` points as its roots, and per coefficient the weights of the values at the points in the polynomial through them."""
    zs, whole = points(n), [1]
    for z in zs:
        whole = _times(whole, [-z % P, 1])
    parts = []
    for z in zs:
        part, _ = _divide(whole, [-z % P, 1])
        scale, v = 0, 1
        for c in part:
            scale, v = (scale + c * v) % P, v * z % P
        inv = pow(scale, -1, P)
        parts.append([c * inv % P for c in part])
    return whole, [list(c) for c in zip(*parts)]


def _value(poly: list[int], z: int) -> int:
    """Of the monic polynomial with lower coefficients ``poly`` (constant first)."""
    v = 1
    for c in reversed(poly):
        v = (v * z + c) % P
    return v


def interpolate(na: int, nb: int, va: list[int], vb: list[int], bound: int) -> tuple[list[int], list[int]] | None:
    """Monic numerator and denominator (lower coefficients) of the quotient of two characteristic polynomials, from their values at :func:`points`; None if ``bound`` is too small.

    ``bound`` points fit the degrees, the rest verify. The polynomial through the quotients and the one with the points as
    its roots are divided by Euclid's algorithm until the remainder has at most the numerator's degree; remainder and
    cofactor are then numerator and denominator without common factor, if the degrees fit the bound.
    """
    delta = na - nb
    if abs(delta) > bound:
        return None
    zs = points(len(va))
    f = [a * pow(b, -1, P) % P for a, b in zip(va, vb)]
    if not bound:
        return ([], []) if all(x == 1 for x in f) else None
    whole, weights = _basis(bound)
    r0, r1 = whole, _trim([sum(map(int.__mul__, f, w)) % P for w in weights])
    t0, t1 = [], [1]
    most = (bound + delta) // 2
    while len(r1) - 1 > most:
        q, rest = _divide(r0, r1)
        step = _times(q, t1)
        t0, t1 = t1, _trim([((t0[i] if i < len(t0) else 0) - (step[i] if i < len(step) else 0)) % P for i in range(max(len(t0), len(step)))])
        r0, r1 = r1, rest
    if not r1 or not t1 or len(r1) - len(t1) != delta or len(r1) - 1 > na or len(t1) - 1 > nb:
        return None
    inv = pow(t1[-1], -1, P)
    if r1[-1] != t1[-1]:
        return None  # both are monic
    num, den = [x * inv % P for x in r1[:-1]], [x * inv % P for x in t1[:-1]]
    if any(_value(num, z) != q * _value(den, z) % P for z, q in zip(zs, f)):
        return None
    return num, den


def _solve(bound: int):
    """Per joined sketch of buckets that differ: the polynomials of both sides, or that the bound is too small."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                got = interpolate(r["na"], r["nb"], r["va"], r["vb"], bound)
                out.append((r["bucket"], got is not None, *(got or ([], []))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_()), pa.array([x[2] for x in out], pa.list_(pa.int64())), pa.array([x[3] for x in out], pa.list_(pa.int64()))], names=["bucket", "ok", "num", "den"])

    return run


def _roots(batches):
    """Keys of rows whose hash is a root of their bucket's polynomial."""
    import numpy as np
    import pyarrow as pa

    p = np.uint64(P)
    for batch in batches:
        h = batch.column("h").to_numpy().astype(np.uint64)
        poly = batch.column("poly")
        n = np.asarray(poly.value_lengths())
        flat = np.asarray(poly.flatten()).astype(np.uint64)
        start = np.r_[0, np.cumsum(n)[:-1]]
        value = np.ones(len(h), dtype=np.uint64)
        for k in range(int(n.max()) if len(n) else 0):
            on = np.flatnonzero(k < n)
            value[on] = mulmod(value[on], h[on]) + flat[start[on] + n[on] - 1 - k]
            value[on] = np.where(value[on] >= p, value[on] - p, value[on])
        hit = pa.array((value == 0) & (n > 0))
        yield batch.select(["key"]).filter(hit)


def _hashed(rows: DataFrame, key: str, fields: list[str], buckets: int) -> DataFrame:
    """(key, h, bucket) of each distinct row: its hash in the field, and its bucket, which follows from the whole row so that one hot key is spread. Written once, for it is read for every bound."""
    # the null flags tell null from empty, the second seed makes bucket and hash independent
    cols = [c for f in fields for c in (F.col(f), F.col(f).isNull())]
    h = F.pmod(F.xxhash64(*cols, F.lit(17)), F.lit(2**60))
    return materialise(rows.select(F.col(key).alias("key"), h.alias("h"), F.pmod(F.xxhash64(F.lit(5), *cols), F.lit(buckets)).alias("bucket")).distinct(), "hashes")


def differing_keys(left: DataFrame, right: DataFrame, key: str, fields: list[str], *, bucket_rows: int = 128, bound: int = 16) -> DataFrame:
    """(key), distinct: keys of rows (``fields``, with the key) that only one side has."""
    buckets = max(1, -(-max(left.count(), right.count()) // bucket_rows))
    a, b = _hashed(left, key, fields, buckets), _hashed(right, key, fields, buckets)
    sizes = [x.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")) for x in (a, b)]
    size = sizes[0].withColumnRenamed("size", "na").join(sizes[1].withColumnRenamed("size", "nb"), "bucket", "full").select("bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("na", "nb")])
    size = materialise(size, "sizes")
    # where one side has nothing all rows of the other are roots
    lone = size.filter("na = 0 or nb = 0").select("bucket")
    keys = [x.join(lone, "bucket", "left_semi").select("key") for x in (a, b)]
    # the largest difference of sizes: up to twice that bound, buckets of smaller ones come first
    least = (size.filter("na > 0 and nb > 0").agg(F.max(F.abs(F.col("na") - F.col("nb")))).head()[0]) or 0
    open_, waits = None, size.filter("na > 0 and nb > 0").select("bucket", F.abs(F.col("na") - F.col("nb")).alias("off"))
    while True:
        # a bucket is tried once the bound holds the difference of its sizes and some rows that changed
        now = waits.filter(F.col("off") * 5 <= 4 * bound if bound < 2 * least else F.lit(True)).select("bucket")
        waits = waits.filter(~(F.col("off") * 5 <= 4 * bound)) if bound < 2 * least else waits.filter("false")
        open_ = now if open_ is None else open_.unionByName(now)
        sa, sb = (sketches(x.join(open_, "bucket", "left_semi").select("bucket", "h").distinct(), bound + CHECKS) for x in (a, b))
        both = sa.select("bucket", F.col("size").alias("na"), F.col("values").alias("va")).join(sb.select("bucket", F.col("size").alias("nb"), F.col("values").alias("vb")), "bucket").filter("na <> nb or va <> vb")
        got = materialise(both.mapInArrow(_solve(bound), "bucket bigint, ok boolean, num array<bigint>, den array<bigint>"), "polynomials")
        fine = got.filter("ok")
        for hashes, poly in ((a, "num"), (b, "den")):
            roots = hashes.join(fine.select("bucket", F.col(poly).alias("poly")), "bucket").select("key", "h", "poly")
            keys.append(roots.mapInArrow(_roots, f"key {hashes.schema['key'].dataType.simpleString()}"))
        open_ = got.filter("not ok").select("bucket")
        if bound >= 2 * least and open_.isEmpty():
            break
        bound *= 2
    out = keys[0]
    for k in keys[1:]:
        out = out.unionByName(k)
    return materialise(out.distinct(), "keys")


def differences(left: DataFrame, right: DataFrame, key: str, fields: list[str], names: tuple[str, str], *, bucket_rows: int = 128, bound: int = 16) -> DataFrame:
    """``key`` and ``difference``: the name for keys that one side lacks, or each field whose values differ.

    Both sides have ``key`` and ``fields`` of the same types. Null is a value: it differs from empty. Where a side has
    several rows of a key, a field differs if the sets of its values do; repeated rows are one. Keys that are null are
    compared like any other. Two empty tables have no differences.
    """
    cols = [key, *fields]
    keys = differing_keys(left, right, key, cols, bucket_rows=bucket_rows, bound=bound).withColumnRenamed("key", "_key")
    # fetch every row of those keys, for a key may also have rows on which both sides agree
    sides = None
    for side, rows in ((1, left), (2, right)):
        got = rows.select(*cols).join(keys, rows[key].eqNullSafe(keys["_key"]), "left_semi").withColumn("_side", F.lit(side))
        sides = got if sides is None else sides.unionByName(got)
    value = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    cells = sides.select(key, "_side", value.alias("_c")).select(key, "_side", F.col("_c.field").alias("_field"), F.col("_c.value").alias("_value"))
    # which sides have a value; combined before the shuffle
    per_value = cells.groupBy(key, "_field", "_value").agg(F.bit_or("_side").alias("_in"))
    per_field = per_value.groupBy(key, "_field").agg(F.bit_or("_in").alias("_in"), F.min("_in").alias("_least"))
    one = F.when(F.col("_in") == 1, F.lit(names[0])).when(F.col("_in") == 2, F.lit(names[1])).when(F.col("_least") < 3, F.col("_field"))
    return per_field.select(key, one.alias("difference")).filter("difference is not null").distinct()
