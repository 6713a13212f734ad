"""Numbers of variable scale against exact arithmetic, of any length."""

from decimal import ROUND_HALF_UP, Context, Decimal

from pyspark.sql import functions as F

from rillstone.functions import logical


def test_numbers_of_any_length(spark):
    cases = [(0, 5), (1, -5), (3, 12345), (18, 10**37), (18, 2**120), (18, -(2**125)), (18, 2**126), (0, 2**130), (0, -(2**130)), (2, -1), (19, 5), (-2, 7), (18, -(10**37)), (0, -(2**63)), (4, 2**64), (0, 0)]
    data = [(s, n.to_bytes(n.bit_length() // 8 + 1 + more, "big", signed=True), n) for s, n in cases for more in (0, 1, 7, 20)]
    df = spark.createDataFrame([(i, s, b) for i, (s, b, _) in enumerate(data)] + [(-1, 0, None), (-2, 0, b"\x7f" + b"\x00" * 20)], "i int, s int, v binary")
    got = {r.i: r.d for r in df.select("i", logical.variable_scale_decimal(F.col("s"), F.col("v")).alias("d")).collect()}
    assert got[-1] is None and got[-2] is None
    wide = Context(prec=90, rounding=ROUND_HALF_UP)
    for i, (s, _, n) in enumerate(data):
        want = wide.quantize(wide.scaleb(Decimal(n), -s), Decimal(1).scaleb(-18))
        assert got[i] == (want if abs(want) < 10**20 and abs(n) < 10**38 else None), (s, n)
