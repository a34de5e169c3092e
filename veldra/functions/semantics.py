"""IEEE-754 arithmetic as Spark columns: division and logarithms that give infinities and NaN where Spark raises or gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")
#: From this magnitude on every double is a whole number.
WHOLE = 4503599627370496.0


def ieee_div(a: Column, b: Column) -> Column:
    """a / b: the sign of a zero divisor counts, 0/0 is NaN. Never raises, also not when Spark folds constants."""
    return F.when(b == 0.0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def ieee_pow(a: Column, b: Column) -> Column:
    """C's pow: 1 to any power is 1, also to NaN, and so is -1 to an infinite one, where Java gives NaN."""
    return F.when((a == 1.0) | (a == -1.0) & (F.abs(b) == INF), F.lit(1.0)).otherwise(F.pow(a, b))


def ieee_ln(a: Column) -> Column:
    return F.when(a == 0.0, F.lit(-INF)).when(a < 0.0, F.lit(NAN)).otherwise(F.ln(a))


def ieee_log10(a: Column) -> Column:
    return F.when(a == 0.0, F.lit(-INF)).when(a < 0.0, F.lit(NAN)).otherwise(F.log10(a))


def ieee_floor(a: Column) -> Column:
    """Floor as a double; NaN, infinities and large values pass."""
    return F.when(F.abs(a) < WHOLE, F.floor(a).cast("double")).otherwise(a)


def ieee_ceil(a: Column) -> Column:
    return F.when(F.abs(a) < WHOLE, F.ceil(a).cast("double")).otherwise(a)
