"""Costs of any length against Python's decimals."""

import random
from decimal import Context, Decimal, InvalidOperation

from pyspark.sql import functions as F

from causeway.functions import costs


def bounded(d):
    sign, digits, e = d.as_tuple()
    length = (1 if d.is_zero() else len(digits) + e) if e >= 0 else max(len(digits) + 1, 2 - e)
    return sign + length <= costs.COST_CHARS


def fixed(text):
    try:
        d = Decimal(text)
    except (InvalidOperation, TypeError):
        return None
    return format(d, "f") if d.is_finite() and d >= 0 and bounded(d) else None


TEXTS = ["0", "-0", "0.00", "1", "+1.50", ".5", "5.", "007.10", "1e3", "1E-3", "0e5", "1e63", "1e64", "9e-62", "9e-63", "1e1000000", "1e-99999999999", "-1", "nan", "Infinity", "", " 2 ", "1_000", "1,5", "$3", None, "1" * 64, "1" * 65, "1." + "2" * 62, "1." + "2" * 63, "-0.0", "0.1e1", "12345678901234567890123456789012345678901234567890.123456789"]


def test_fixed_text(spark):
    got = spark.createDataFrame(list(enumerate(TEXTS)), "i int, c string").select("i", costs.fixed(F.col("c")).alias("f")).collect()
    assert {TEXTS[r.i]: r.f for r in got} == {t: fixed(t) for t in TEXTS}


def test_sums_and_differences(spark):
    rng = random.Random(2)
    rows = [(g, f"{rng.randrange(10 ** rng.randrange(1, 40))}.{rng.randrange(10 ** 20):0{rng.randrange(1, 22)}d}") for g in range(20) for _ in range(rng.randrange(1, 30))]
    rows += [(50, "9" * 64)] * 40 + [(51, "0." + "9" * 62)] * 40 + [(52, "0.10"), (52, "0.2")] + [(53, None)]
    exact = Context(prec=400)
    want = {}
    for g, t in rows:
        if t is not None:
            want[g] = exact.add(want.get(g, Decimal(0)), Decimal(t))
    table = spark.createDataFrame(rows, "g int, c string").groupBy("g").agg(costs.summed(costs.fixed(F.col("c"))).alias("s")).select("g", costs.total(F.col("s")).alias("total"))
    got = {r.g: r.total for r in table.collect()}
    assert got.pop(53) is None and got == {g: format(d, "f") for g, d in want.items()}
    totals = [(a, b) for a in got.values() for b in got.values()]
    pairs = spark.createDataFrame(totals, "a string, b string")
    for r in pairs.select("a", "b", costs.difference(F.col("a"), F.col("b")).alias("d")).collect():
        assert Decimal(r.d) == exact.subtract(Decimal(r.a), Decimal(r.b)) and r.d == format(exact.subtract(Decimal(r.a), Decimal(r.b)), "f"), r
