"""Column functions that depend on other rows: ranks, differences, rolling means, z-scores.

Order-dependent ones take ``order_by`` (unique per row) and optionally ``partition_by``; none of
them puts a whole group, or the whole table, into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscan.functions import coerce as c
from ledgerscan.plans import keyed
from ledgerscan.plans.ordered import OrderedRows

#: Windows up to this many rows are added up row by row, larger ones from blocks.
SLIDING_ROWS = 64


def rank(
    df: DataFrame, column: str, new_col: str, partition_by: Sequence[str] = (), ascending: bool = True, dense: bool = False
) -> DataFrame:
    """Rank of the coerced number: ``min`` rank, or dense rank; null stays null.

    Ranks are computed on the distinct values with their counts and joined back.
    """
    keys = {f"__p{i}": F.col(f"`{p}`") for i, p in enumerate(partition_by)}
    keys["__x"] = c.num(df, column)
    counted = keyed.group_stats(df, keys, {}).filter("__x is not null")
    order = [F.asc("__x") if ascending else F.desc("__x")]
    ordered = OrderedRows(counted, order, [k for k in keys if k != "__x"])
    if dense:
        ranked = ordered.with_position(new_col)
    else:
        ranked = ordered.with_running_sum(F.col("__weight"), "__upto")
        ranked = ranked.withColumn(new_col, F.col("__upto") - F.col("__weight") + 1).drop("__upto")
    return keyed.attach(df, keys, ranked.drop("__bucket", "__at")).drop("__weight", "__keep")


def _named(df: DataFrame, new_col: str) -> list[str]:
    return [f"`{n}`" for n in [*[n for n in df.columns if n != new_col], new_col]]


def _directed(order_by: Sequence[str], periods: int) -> list[Column]:
    return [F.asc(f"`{o}`") if periods >= 0 else F.desc(f"`{o}`") for o in order_by]


def difference(df, column, new_col, order_by, partition_by=(), periods: int = 1) -> DataFrame:
    """Value minus the value ``periods`` rows before (after, if negative). Lays the rows out (runs jobs)."""
    ordered = OrderedRows(df, _directed(order_by, periods), partition_by)
    rows = ordered.rows.withColumn("__x", c.num(df, column))
    rows = ordered.with_lag(rows, "__x", "__other", abs(int(periods)))
    return rows.withColumn(new_col, F.col("__x") - F.col("__other")).select(*_named(df, new_col))


def percent_change(df, column, new_col, order_by, partition_by=(), periods: int = 1) -> DataFrame:
    """Relative change against ``periods`` rows before, after carrying known values over nulls (runs jobs)."""
    if periods < 0:
        raise ValueError("percent change looks back only; reverse order_by instead")
    ordered = OrderedRows(df, _directed(order_by, periods), partition_by)
    rows = ordered.with_last_known(c.num(df, column), "__x")
    rows = ordered.with_lag(rows, "__x", "__other", int(periods))
    return rows.withColumn(new_col, F.try_divide("__x", "__other") - 1).select(*_named(df, new_col))


def rolling_mean(df, column, new_col, order_by, partition_by=(), window: int = 3) -> DataFrame:
    """Mean of the known values among the last ``window`` rows (runs jobs).

    Large windows cost no more than small ones: every group is cut into blocks of ``window`` rows,
    and the rows looked at are the end of one block and the beginning of the next. Both sums are
    running sums of a block, so nothing is subtracted and no digits are lost.
    """
    size = int(window)
    ordered = OrderedRows(df, _directed(order_by, 1), partition_by)
    rows = ordered.rows.withColumn("__x", c.num(df, column))
    if size <= SLIDING_ROWS:
        rows = ordered.with_halo(rows, size - 1, ["__x"])
        rows = rows.withColumn(new_col, F.avg("__x").over(ordered.window().rowsBetween(1 - size, 0)))
        return rows.filter(~F.col("__halo")).select(*_named(df, new_col))
    rows = ordered.divided(rows).with_position("__r").withColumn("__r", F.col("__r") - 1)
    rows = rows.withColumn("__block", F.floor(F.col("__r") / size))
    x, known = F.col("__x"), F.col("__x").isNotNull().cast("long")
    rows = ordered.divided(rows, "__block").with_running_sums(
        {"__sum": x, "__count": known}, after={"__sum": "__sum_after", "__count": "__count_after"}
    )
    rows = rows.withColumn("__tail", F.struct(F.col("__sum_after").alias("sum"), F.col("__count_after").alias("count")))
    rows = ordered.with_lag(rows, "__tail", "__tail_before", size - 1)
    # the last row of a block looks at this block alone
    crosses = F.col("__r") % size != size - 1
    total = F.col("__sum") + F.coalesce(F.when(crosses, F.col("__tail_before.sum")), F.lit(0.0))
    count = F.col("__count") + F.coalesce(F.when(crosses, F.col("__tail_before.count")), F.lit(0))
    return rows.withColumn(new_col, F.when(count > 0, total / count)).select(*_named(df, new_col))


def running_sum(df, column, new_col, order_by, partition_by=()) -> DataFrame:
    ordered = OrderedRows(df, list(order_by), partition_by)
    return ordered.with_running_sum(c.num(df, column), new_col).select(*df.columns, new_col)


def zscore(df: DataFrame, column: str) -> Column:
    """Distance from the column mean in population standard deviations; 0 if there is no spread."""
    x = c.num(df, column)
    stats = df.agg(F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")).alias("s")).scalar()
    return F.when(F.coalesce(stats["std"], F.lit(0.0)) == 0, F.lit(0.0)).otherwise((x - stats["mean"]) / stats["std"])


def correlation(df: DataFrame, a: str, b: str) -> Column:
    return df.agg(c.finite(F.corr(c.num(df, a), c.num(df, b))).alias("r")).scalar()


def covariance(df: DataFrame, a: str, b: str) -> Column:
    return df.agg(F.covar_pop(c.num(df, a), c.num(df, b)).alias("r")).scalar()
