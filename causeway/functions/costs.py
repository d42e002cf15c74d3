"""Costs as decimals of any length that a record may have: exact text, exact sums and differences over limbs of nine digits.

A cost is text; only finite values of zero or more, of at most COST_CHARS characters written out, count. Sums add the limbs of fixed
positions as whole numbers, so partial sums are exact in any order, and carry once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Costs longer than this, written out, aren't summed. The bound is computed from digits and exponent, before anything is written out.
COST_CHARS = 64
#: Digits before and after the point that sums are kept in; a sum of 10^26 costs fits.
WHOLE, PART, LIMB = 90, 63, 9
_DECIMAL = r"^\s*([+-]?)(?:([0-9]+)(?:\.([0-9]*))?|\.([0-9]+))(?:[eE]([+-]?[0-9]+))?\s*$"
#: A cost that is in fixed form as it stands.
_PLAIN = r"^(?:0|[1-9][0-9]*)(?:\.[0-9]+)?\z"


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once: the expression stays small where it is used many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fixed(text: Column) -> Column:
    """A cost's text without exponent, all its digits kept; null for what is no cost."""
    names = ("sign", "whole", "part", "short", "exponent")

    def read(t: Column) -> Column:
        return F.struct(t.rlike(_DECIMAL).alias("fits"), *[F.regexp_extract(t, _DECIMAL, k).alias(n) for k, n in enumerate(names, 1)])

    def sized(g: Column) -> Column:
        part = F.concat(g["part"], g["short"])
        exponent = F.when(g["exponent"] == "", 0).otherwise(g["exponent"].try_cast("int").cast("long"))
        return F.struct(g["fits"].alias("fits"), g["sign"].alias("sign"), F.regexp_replace(F.concat(g["whole"], part), "^0+", "").alias("digits"), (F.length(part) - exponent).alias("scale"))

    def written(x: Column) -> Column:
        digits, scale, n, zero = x["digits"], x["scale"], F.length(x["digits"]), x["digits"] == ""
        length = F.when(scale > 0, F.greatest(n + 1, F.lit(2), scale + 2)).when(zero, 1).otherwise(n - scale) + (x["sign"] == "-").cast("int")
        bounded = F.coalesce(x["fits"] & (length <= COST_CHARS) & (zero | (x["sign"] != "-")), F.lit(False))
        # nothing is written out for a longer one
        return _let(F.when(bounded, F.struct(F.when(x["sign"] == "-", "-").otherwise("").alias("sign"), digits.alias("digits"), scale.cast("int").alias("places"))), spelled)

    def spelled(y: Column) -> Column:
        padded = F.lpad(y["digits"], F.greatest(F.length(y["digits"]), y["places"] + 1), F.lit("0"))
        point = _let(padded, lambda p: F.concat(F.substring(p, F.lit(1), F.length(p) - y["places"]), F.lit("."), F.substring(p, F.length(p) - y["places"] + 1, y["places"])))
        plain = F.when(y["digits"] == "", "0").otherwise(F.concat(y["digits"], F.repeat(F.lit("0"), -y["places"])))
        return F.concat(y["sign"], F.when(y["places"] > 0, point).otherwise(plain))

    # most are absent, or written so: lambdas are interpreted row by row
    plain = text.rlike(_PLAIN) & (F.length(text) <= COST_CHARS)
    return F.when(text.isNull() | plain, text).otherwise(_let(F.replace(text, F.lit("_"), F.lit("")), lambda t: _let(read(t), lambda g: _let(sized(g), written))))


def _digits(cost: Column) -> Column:
    """All digit places of a cost in ``fixed`` form."""
    plain = F.ltrim(cost, F.lit("-"))
    part = F.when(F.contains(plain, F.lit(".")), F.substring_index(plain, ".", -1)).otherwise("")
    return F.concat(F.lpad(F.substring_index(plain, ".", 1), WHOLE, "0"), F.rpad(part, PART, "0"))


def _limb_of(cost: Column, k: int) -> Column:
    """Limb k of a cost in ``fixed`` form that isn't below zero. Few costs are long: the others' far limbs are zero and nothing is padded for them."""
    point = WHOLE // LIMB
    whole, part = F.substring_index(cost, ".", 1), F.when(F.contains(cost, F.lit(".")), F.substring_index(cost, ".", -1)).otherwise("")
    if k < point:
        over = F.length(whole) - LIMB * (point - 1 - k)  # digits up to this limb's last
        return F.when(over > 0, F.substring(whole, F.greatest(over - LIMB + 1, F.lit(1)), F.least(over, F.lit(LIMB))).cast("long")).otherwise(0)
    first = LIMB * (k - point)
    return F.when(F.length(part) > first, F.rpad(F.substring(part, first + 1, LIMB), LIMB, "0").cast("long")).otherwise(0)


def _limb(digits: Column, k: int) -> Column:
    return F.substring(digits, LIMB * k + 1, LIMB).cast("long")


def _places(cost: Column) -> Column:
    return F.when(F.contains(cost, F.lit(".")), F.length(F.substring_index(cost, ".", -1))).otherwise(0)


def _written(limbs: Column, places: Column) -> Column:
    """Limbs, each of any size or sign, as digits with so many places after the point."""
    unit = 10**LIMB
    # the remainder is taken first: a borrow is a carry below zero
    low = lambda v: F.pmod(v, F.lit(unit))
    step = lambda acc, v: F.struct(F.floor((v + acc["carry"] - low(v + acc["carry"])).cast("decimal(20,0)") / unit).cast("long").alias("carry"), F.concat(F.lpad(low(v + acc["carry"]).cast("string"), LIMB, "0"), acc["text"]).alias("text"))
    text = F.aggregate(F.reverse(limbs), F.struct(F.lit(0).cast("long").alias("carry"), F.lit("").alias("text")), step, lambda acc: acc["text"])
    whole = F.regexp_replace(F.substring(text, 1, WHOLE), "^0+(?=[0-9])", "")
    return F.concat(whole, F.when(places > 0, F.concat(F.lit("."), F.substring(text, F.lit(WHOLE + 1), places))).otherwise(""))


def summed(cost: Column) -> Column:
    """The aggregate of a column in ``fixed`` form that ``total`` reads."""
    plain = F.ltrim(cost, F.lit("-"))  # zero may have a sign
    sums = [F.sum(_limb_of(plain, k)) for k in range((WHOLE + PART) // LIMB)]
    return F.when(F.count(cost) > 0, F.struct(F.array(*sums).alias("limbs"), F.max(_places(cost)).alias("places")))


def total(sums: Column) -> Column:
    """The exact sum, with as many places as the summand that has most."""
    return F.when(sums.isNotNull(), _written(sums["limbs"], sums["places"]))


def difference(a: Column, b: Column) -> Column:
    """a - b of two sums, exact."""

    def written(d: Column) -> Column:
        limbs = F.array(*[_limb(d["high"], k) - _limb(d["low"], k) for k in range((WHOLE + PART) // LIMB)])
        return F.concat(d["sign"], _written(limbs, d["places"]))

    def ordered(d: Column) -> Column:
        high, low = F.greatest(d["x"], d["y"]), F.least(d["x"], d["y"])
        return F.struct(high.alias("high"), low.alias("low"), d["places"].alias("places"), F.when(d["x"] < d["y"], "-").otherwise("").alias("sign"))

    both = F.struct(_digits(a).alias("x"), _digits(b).alias("y"), F.greatest(_places(a), _places(b)).alias("places"))
    return F.when(a.isNotNull() & b.isNotNull(), _let(both, lambda d: _let(ordered(d), written)))
