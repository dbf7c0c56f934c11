"""A keyed permutation of 0..n-1 as Spark expressions: Feistel rounds and cycle walking.

A number below a * b >= n is split into a digit below a and one below b; each round adds a hash
of one digit to the other. That is a bijection of 0..a*b-1. Values that land at n or above are
put through it again until they fall below n (cycle walking), which is a bijection of 0..n-1.
With a = ceil(sqrt(n)) and b = ceil(n / a) fewer than a values lie outside.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import div

ROUNDS = 6
#: Outside values number fewer than sqrt(n), so a walk this long has a chance below n ** -30 and,
#: for n up to 4096, cannot happen at all; if it did, the job would fail rather than repeat a number.
WALK = 64


def _radices(n: Column) -> tuple[Column, Column]:
    a = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1))
    return a, F.greatest(div(n + a - 1, a), F.lit(1))


def _rounds(x: Column, n: Column, key: Column, forward: bool) -> Column:
    a, b = _radices(n)
    start = F.struct(F.pmod(x, a).alias("l"), div(x, a).alias("r"))

    def turn(s: Column, i: Column) -> Column:
        sign = F.lit(1 if forward else -1).cast("long")
        left = F.pmod(s["l"] + sign * F.pmod(F.xxhash64(key, i, s["r"]), a), a)
        right = F.pmod(s["r"] + sign * F.pmod(F.xxhash64(key, i, s["l"]), b), b)
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"),
                        F.when(even, s["r"]).otherwise(right).alias("r"))

    order = range(ROUNDS) if forward else reversed(range(ROUNDS))
    return F.aggregate(F.array(*[F.lit(i) for i in order]), start, turn, lambda s: s["r"] * a + s["l"])


def _walked(x: Column, n: Column, key: Column, forward: bool) -> Column:
    step = lambda v: _rounds(v, n, key, forward)
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(x),
                       lambda v, _: F.when(v < n, v).otherwise(step(v)),
                       lambda v: F.when(v < n, v).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long")))
    return F.when(n <= 1, x).otherwise(walk)


def permute(x: Column, n: Column, key: Column) -> Column:
    """The place of number ``x`` (0 <= x < n) in the permutation named by ``key``; all may be columns."""
    return _walked(x.cast("long"), n.cast("long"), key, True)


def unpermute(y: Column, n: Column, key: Column) -> Column:
    """The number whose place is ``y``: the inverse of :func:`permute`."""
    return _walked(y.cast("long"), n.cast("long"), key, False)
