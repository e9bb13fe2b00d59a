"""Numbers as columns: rounding from the binary value, and permutations of row numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1, cuts a double into two halves whose products are exact


def _halves(x: float) -> tuple[float, float]:
    high = x * _SPLIT - (x * _SPLIT - x)
    return high, x - high


def exact_round(x: Column, digits: int = 0) -> Column:
    """x to so many decimal digits (0 to 15), from its binary value: what is nearest, and on a true tie what is even.

    round() goes by the shortest decimal string, so it takes 2.675 up, though the double is below that. Here x * 10^digits
    is a product and its exact error, which decide together. From 2^53 on, and for infinities and NaN, x stays as it is.
    """
    c = 10.0**digits
    c_high, c_low = _halves(c)
    p = x * c
    high = x * _SPLIT - (x * _SPLIT - x)
    low = x - high
    e = ((high * c_high - p) + high * c_low + low * c_high) + low * c_low
    floor = F.floor(p).cast("double")
    d = p - floor
    under = (d == 0) & (e < 0)  # just below a whole number: the fraction is 1 + e
    below = F.when(under, floor - 1).otherwise(floor)
    half = F.when(under, F.lit(0.5)).otherwise(d - 0.5)  # the fraction is above a half if half > -e
    up = (half > -e) | ((half == -e) & (F.pmod(below, F.lit(2.0)) == 1))
    whole = F.when(up, below + 1).otherwise(below)
    out = F.when((whole == 0) & (x < 0), F.lit(-0.0)).otherwise(whole / c)
    return F.when(F.isnan(x) | (F.abs(p) >= 2.0**53) | (x == 0), x).otherwise(out)


#: Rounds of a permutation; each one may swap a number with a partner.
ROUNDS = 24


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A permutation of 0..n-1 that the key decides, at x: no table of it is made and nothing is sorted.

    Swap or not: in each round numbers are paired by a sum that the round's key gives, and a bit that hangs on the pair
    says whether they change places. Every round is its own inverse, so each is a permutation.
    """

    def drawn(*parts: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in (*key, *parts)])), 1, 8), 16, 10).cast("long")

    def step(v: Column, k: Column) -> Column:
        partner = F.pmod(drawn(F.lit("k"), k) - v, n)
        return F.when(drawn(k, F.greatest(v, partner)) % 2 == 1, partner).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)
