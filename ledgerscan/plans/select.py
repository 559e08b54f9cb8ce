"""The n-th row of an order, without bringing n rows together.

Sketched quantiles give two keys around the wanted rank and one pass counts what lies above and between
them; only the rows between are put in order, by range partitions, and one of them is the answer. If many
rows share a key, they lie between and are told apart by their ties, over many partitions like any other range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ledgerscan.plans.ordered import OrderedRows

#: Up to so many rows are a bounded top-k in one task.
SMALL = 10_000
#: The sketch is off by at most one in so many rows.
ACCURACY = 10_000


def nth_row(df: DataFrame, key: Column, ties: Sequence[str], n: int, largest: bool) -> Row | None:
    """``key`` and ``ties`` of the n-th row (from 1) by ``key`` and then by ``ties``; None if there are fewer rows.

    ``key`` is a number; rows without one do not count. Two passes over the narrow columns run here.
    """
    narrow = df.select((-key if largest else key).alias("__key"), *[F.col(f"`{t}`") for t in ties]).filter("__key is not null")
    total = narrow.count()
    if n > total or n < 1:
        return None
    shares = [max(0.0, min(1.0, n / total + d * 2 / ACCURACY)) for d in (-1, 1)]
    low, high = narrow.agg(F.percentile_approx("__key", shares, ACCURACY).alias("at")).first()["at"]
    at = F.col("__key")
    seen = narrow.agg(F.count_if(at < low).alias("above"), F.count_if(at.between(low, high)).alias("between")).first()
    if seen["above"] < n <= seen["above"] + seen["between"]:
        narrow, n = narrow.filter(at.between(low, high)), n - seen["above"]
    placed = OrderedRows(narrow, ["__key", *ties]).with_place("__place")
    found = placed.filter(F.col("__place") == n).select("__key", *[F.col(f"`{t}`") for t in ties])
    return found.first()


def up_to(row: Row, key: Column, ties: Sequence[str], largest: bool, schema) -> Column:
    """Whether a row comes no later than ``row`` of :func:`nth_row`."""
    mine, bound = (-key if largest else key), F.lit(row["__key"])
    order = F.struct(*[F.col(f"`{t}`") for t in ties])
    last = F.struct(*[F.lit(row[t]).cast(schema[t].dataType).alias(t) for t in ties])
    return (mine < bound) | ((mine == bound) & (order <= last))
