"""Scalar mathematics. A result outside a function's domain is null, never NaN or an error."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscan.functions.coerce import finite

# Above this magnitude a double has no fractional part (and floor() would leave the long range).
_EXACT = float(2**53)


def floor(x: Column) -> Column:
    return F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)


def ceil(x: Column) -> Column:
    return F.when(F.abs(x) < _EXACT, F.ceil(x).cast("double")).otherwise(x)


def trunc(x: Column) -> Column:
    return F.when(x < 0, ceil(x)).otherwise(floor(x))


def _scaled(x: Column, decimals: int, step) -> Column:
    factor = F.lit(10.0 ** int(decimals))
    return step(x * factor) / factor


def half_even(x: Column, decimals: int = 0) -> Column:
    """Rounding of ties to the even neighbour, on the scaled double."""
    if decimals < 0:
        factor = F.lit(10.0 ** -int(decimals))
        return F.rint(x / factor) * factor
    return _scaled(x, decimals, F.rint)


def round_up(x: Column, decimals: int = 0) -> Column:
    """Towards plus infinity (not away from zero)."""
    return _scaled(x, decimals, ceil)


def round_down(x: Column, decimals: int = 0) -> Column:
    """Towards minus infinity (not towards zero)."""
    return _scaled(x, decimals, floor)


def truncate(x: Column, decimals: int = 0) -> Column:
    return _scaled(x, decimals, trunc)


def ceiling(x: Column, significance: float = 1.0) -> Column:
    s = F.lit(float(significance))
    return ceil(F.try_divide(x, s)) * s


def floor_to(x: Column, significance: float = 1.0) -> Column:
    s = F.lit(float(significance))
    return floor(F.try_divide(x, s)) * s


def mod(x: Column, y: Column | float) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    y = y if isinstance(y, Column) else F.lit(float(y))
    rest = F.try_mod(x, y)
    return F.when((rest != 0) & ((rest < 0) != (y < 0)), rest + y).otherwise(rest)


def even(x: Column) -> Column:
    return ceil(x / 2) * 2


def odd(x: Column) -> Column:
    up = ceil(x)
    return F.when(mod(up, 2.0) == 0, up + 1).otherwise(up)


def power(x: Column, y: Column | float = 2.0) -> Column:
    return finite(F.pow(x, y if isinstance(y, Column) else F.lit(float(y))))


def sqrt(x: Column) -> Column:
    return F.when(x >= 0, F.sqrt(x))


def exp(x: Column) -> Column:
    return finite(F.exp(x))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x > 0, F.log10(x))


def log(x: Column, base: float = 10.0) -> Column:
    base = float(base)
    if base <= 0 or base == 1:
        return F.lit(None).cast("double")
    return ln(x) / F.lit(math.log(base))


def asin(x: Column) -> Column:
    return F.when(x.between(-1, 1), F.asin(x))


def acos(x: Column) -> Column:
    return F.when(x.between(-1, 1), F.acos(x))


def acosh(x: Column) -> Column:
    return F.when(x >= 1, F.acosh(x))


def atanh(x: Column) -> Column:
    return F.when((x > -1) & (x < 1), F.atanh(x))


def reciprocal(x: Column) -> Column:
    return finite(F.try_divide(F.lit(1.0), x))


def factorial(x: Column) -> Column:
    """Factorial of the whole part as a double, for 0 to 170 (exact to 22); null otherwise."""
    steps = F.sequence(F.lit(1), F.floor(x).cast("int"))
    product = F.aggregate(steps, F.lit(1.0), lambda a, k: a * k)
    return F.when((x >= 0) & (x < 1), F.lit(1.0)).when((x >= 1) & (x < 171), product)


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))
