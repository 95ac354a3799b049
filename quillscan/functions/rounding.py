"""Correct decimal rounding of doubles: by their exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 52


def _scaled(c: Column, digits: int) -> Column:
    """round-half-even(c * 10^digits) as a long, for 0 <= c < 1024."""
    big = c * F.lit(float(1 << _BITS))
    n = F.floor(big).cast("decimal(20,0)")
    below = big > F.floor(big).cast("double")  # something was cut off: no tie
    num = (n * F.lit(10 ** digits).cast("decimal(6,0)")).cast("decimal(27,0)")
    one = F.lit(1 << _BITS).cast("decimal(17,0)")
    rest = num % one
    whole = ((num - rest) / one).cast("bigint")
    half = F.lit(1 << (_BITS - 1)).cast("decimal(17,0)")
    up = (rest > half) | ((rest == half) & (below | (whole % 2 == 1)))
    return whole + up.cast("bigint")


def exact_round(c: Column, digits: int) -> Column:
    """The double nearest to ``c`` rounded to ``digits`` places, for 0 <= c < 1024."""
    return _scaled(c, digits).cast("double") / F.lit(float(10 ** digits))


def fixed_text(c: Column, digits: int) -> Column:
    """``c`` with ``digits`` places as text, for 0 <= c < 1024."""
    n = _scaled(c, digits)
    return F.concat(F.floor(n / F.lit(10 ** digits)).cast("string"), F.lit("."),
                    F.lpad((n % F.lit(10 ** digits)).cast("string"), digits, "0"))
