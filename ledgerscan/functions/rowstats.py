"""Statistics across several columns of one row.

Sums are written out over the columns; order statistics and moments work on the small array of the
known values, bound once so that nested uses do not multiply the expression.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscan.functions.coerce import let

Numbers = Sequence[Column]

# Euclid's algorithm needs at most this many steps for 64-bit integers.
_EUCLID_STEPS = 92


def _total(parts: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def row_count(xs: Numbers) -> Column:
    return _total([F.when(x.isNotNull(), 1).otherwise(0) for x in xs])


def row_sum(xs: Numbers) -> Column:
    return _total([_or_zero(x) for x in xs])


def row_product(xs: Numbers) -> Column:
    return reduce(lambda a, b: a * b, [F.coalesce(x, F.lit(1.0)) for x in xs])


def row_sumsq(xs: Numbers) -> Column:
    return _total([_or_zero(F.pow(x, F.lit(2.0))) for x in xs])


def row_mean(xs: Numbers) -> Column:
    return F.try_divide(row_sum(xs), row_count(xs))


def row_min(xs: Numbers) -> Column:
    return F.least(*xs) if len(xs) > 1 else xs[0]


def row_max(xs: Numbers) -> Column:
    return F.greatest(*xs) if len(xs) > 1 else xs[0]


def _sorted(xs: Numbers, ascending: bool = True) -> Column:
    return F.sort_array(F.array_compact(F.array(*xs)), ascending)


def row_percentile(xs: Numbers, q: float) -> Column:
    """Linear interpolation between the two nearest ranks."""

    def between(ordered: Column) -> Column:
        rank = (F.size(ordered) - 1) * F.lit(float(q))
        low, high = F.get(ordered, F.floor(rank).cast("int")), F.get(ordered, F.ceil(rank).cast("int"))
        return F.when(F.size(ordered) > 0, low + (high - low) * (rank - F.floor(rank)))

    return let(_sorted(xs), between)


def row_median(xs: Numbers) -> Column:
    return row_percentile(xs, 0.5)


def row_large(xs: Numbers, k: int) -> Column:
    return F.get(_sorted(xs, ascending=False), F.lit(k - 1))


def row_small(xs: Numbers, k: int) -> Column:
    return F.get(_sorted(xs), F.lit(k - 1))


def _sum_of(known: Column, term) -> Column:
    return F.aggregate(known, F.lit(0.0), lambda total, x: total + term(x))


def _deviations(xs: Numbers, body) -> Column:
    """``body(known values, their number, their mean, sum of squared deviations)``."""

    def with_mean(known: Column) -> Column:
        mean = F.try_divide(_sum_of(known, lambda x: x), F.size(known))
        return let(F.struct(known.alias("known"), mean.alias("mean")), with_squares)

    def with_squares(s: Column) -> Column:
        squares = _sum_of(s["known"], lambda x: (x - s["mean"]) * (x - s["mean"]))
        full = F.struct(s["known"].alias("known"), s["mean"].alias("mean"), squares.alias("squares"))
        return let(full, lambda f: body(f["known"], F.size(f["known"]), f["mean"], f["squares"]))

    return let(F.array_compact(F.array(*xs)), with_mean)


def row_devsq(xs: Numbers) -> Column:
    """Sum of squared deviations from the row mean."""
    return _deviations(xs, lambda known, n, mean, squares: squares)


def row_var(xs: Numbers, ddof: int) -> Column:
    return _deviations(xs, lambda known, n, mean, squares: F.when(n > ddof, F.try_divide(squares, n - ddof)))


def row_std(xs: Numbers, ddof: int) -> Column:
    return F.sqrt(row_var(xs, ddof))


def row_skew(xs: Numbers) -> Column:
    """Population skewness; 0 for fewer than three values or no spread."""

    def body(known, n, mean, squares):
        cubes = _sum_of(known, lambda x: F.pow(x - mean, F.lit(3.0)))
        return F.when((n >= 3) & (squares > 0), cubes / n / F.pow(squares / n, F.lit(1.5))).otherwise(F.lit(0.0))

    return _deviations(xs, body)


def row_kurt(xs: Numbers) -> Column:
    """Population excess kurtosis; 0 for fewer than four values or no spread."""

    def body(known, n, mean, squares):
        fourths = _sum_of(known, lambda x: F.pow(x - mean, F.lit(4.0)))
        return F.when((n >= 4) & (squares > 0), fourths / n / F.pow(squares / n, F.lit(2.0)) - 3).otherwise(F.lit(0.0))

    return _deviations(xs, body)


def _positive(xs: Numbers) -> list[Column]:
    return [F.when(x > 0, x) for x in xs]


def row_geomean(xs: Numbers) -> Column:
    return F.exp(row_mean([F.ln(x) for x in _positive(xs)]))


def row_harmean(xs: Numbers) -> Column:
    kept = _positive(xs)
    return F.try_divide(row_count(kept), row_sum([F.try_divide(F.lit(1.0), x) for x in kept]))


def _whole(x: Column) -> Column:
    """Whole part; 0 for a missing value, null beyond the range of a long."""
    return F.abs(F.when(x.isNull(), F.lit(0).cast("long")).otherwise(x.try_cast("long")))


def _gcd(a: Column, b: Column, kind: str = "long") -> Column:
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(_EUCLID_STEPS)),
        F.struct(a.alias("a"), b.alias("b")),
        lambda s, _: F.when(s["b"] == 0, s).otherwise(
            F.struct(s["b"].alias("a"), F.try_mod(s["a"], s["b"]).cast(kind).alias("b"))
        ),
    )
    return step["a"]


def row_gcd(xs: Numbers) -> Column:
    return reduce(_gcd, [_whole(x) for x in xs])


def row_lcm(xs: Numbers) -> Column:
    """Least common multiple as a whole decimal; 0 if any value is 0 or missing, null beyond 38 digits."""

    def pair(a: Column, b: Column) -> Column:
        divisor = _gcd(a, b.cast("decimal(38,0)"), "decimal(38,0)")
        return F.coalesce(
            F.try_multiply((F.try_divide(a, divisor)).cast("decimal(38,0)"), b.cast("decimal(20,0)")),
            F.when((a == 0) | (b == 0), F.lit(0)),
        ).cast("decimal(38,0)")

    first, *others = [_whole(x) for x in xs]
    return reduce(pair, others, first.cast("decimal(38,0)"))


def text_count(texts: Sequence[Column], blank: bool) -> Column:
    """Number of empty (or non-empty) texts in the row."""
    return _total([F.when((t == "") == F.lit(blank), 1).otherwise(0) for t in texts])
