"""Logic functions on truthy values and fallbacks for missing ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscan.functions import coerce as c


def all_true(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags)


def any_true(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def filled(value: Column, dtype: T.DataType, fallback, empty_is_missing: bool) -> Column:
    """``value``, or ``fallback`` where it is missing (null, optionally empty text, NaN, infinite).

    A numeric column with a numeric fallback stays numeric; otherwise the result is text.
    """
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    if c.is_numeric(dtype):
        number = c.float_param(fallback)
        if number is not None:
            if number == int(number) and isinstance(dtype, T.IntegralType):
                return F.coalesce(value, F.lit(int(number)).cast(dtype))
            return F.coalesce(value, F.lit(number))
        return F.coalesce(value.cast("string"), F.lit(str(fallback)))
    if c.is_datetime(dtype):
        moment = c.date_literal(fallback).cast(dtype)
        return F.coalesce(value, moment) if str(fallback) else value
    if empty_is_missing:
        value = F.nullif(value, F.lit(""))
    return F.coalesce(value, F.lit(str(fallback)))
