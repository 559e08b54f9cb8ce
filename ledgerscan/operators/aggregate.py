"""Group-by with named aggregates, and whole-column reducers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscan.functions import coerce as c
from ledgerscan.plans import keyed, ordered

QUANTILES = {"median": 0.5, "p25": 0.25, "p75": 0.75}
AGGREGATES = [
    "size", "row_count", "count", "nunique", "sum", "mean", "median", "min", "max", "std", "var", "p25", "p75",
    "first", "last",
]


def _aggregate(df: DataFrame, agg: str, column: str | None, order_by: Sequence[str]) -> Column:
    if agg in ("size", "row_count"):
        return F.count(F.lit(1))
    if column not in df.columns:
        raise ValueError(f"Column not found: {column}")
    raw, x = F.col(f"`{column}`"), c.num(df, column)
    if agg in ("first", "last"):
        if not order_by:
            raise ValueError("first/last need order_by columns")
        order = F.when(raw.isNotNull(), keyed.order_key(order_by))
        return (F.min_by if agg == "first" else F.max_by)(raw, order)
    built = {
        "count": lambda: F.count(raw),
        "nunique": lambda: F.count_distinct(raw),
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
        "mean": lambda: F.avg(x),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "std": lambda: F.stddev_pop(x),
        "var": lambda: F.var_pop(x),
    }
    if agg not in built:
        raise ValueError(f"Unsupported aggregation: {agg}")
    return built[agg]()


def group_by(
    df: DataFrame,
    keys: Sequence[str],
    specs: Sequence[tuple[str | None, str, str] | dict],
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One row per key (missing keys form a group); specs are ``(column, aggregate, name)``.

    All aggregates except quantiles come from one partial-then-final aggregation. Exact quantiles
    come from :func:`ledgerscan.plans.ordered.quantiles` and are joined on the keys.
    """
    if not keys or not specs:
        raise ValueError("group_by needs keys and aggregates")
    plain, exact = [], []
    for spec in specs:
        column, agg, name = (
            (spec.get("column"), spec.get("agg", "count"), spec.get("name")) if isinstance(spec, dict) else spec
        )
        name = name or f"{column}_{agg}"
        if agg in QUANTILES:
            exact.append((column, agg, name))
        else:
            plain.append(_aggregate(df, agg, column, order_by).alias(name))
    wanted = [s.get("name") or f"{s.get('column')}_{s.get('agg', 'count')}" if isinstance(s, dict) else s[2] for s in specs]
    key_cols = [F.col(f"`{k}`") for k in keys]
    if not exact:
        return df.groupBy(*key_cols).agg(*plain)
    columns = list(dict.fromkeys(column for column, _, _ in exact))
    points = sorted({QUANTILES[agg] for _, agg, _ in exact})
    numbers = df.select(*key_cols, *[c.num(df, n).alias(f"__n{i}") for i, n in enumerate(columns)])
    table = ordered.quantiles(numbers, keys, [f"__n{i}" for i in range(len(columns))], points)
    table = table.select(
        *[F.col(f"`{k}`").alias(f"__q_{k}") for k in keys],
        *[
            F.col(f"__n{columns.index(column)}__q{points.index(QUANTILES[agg])}").alias(name)
            for column, agg, name in exact
        ],
    )
    base = df.groupBy(*key_cols).agg(*plain) if plain else df.select(*key_cols).distinct()
    on = reduce(lambda a, b: a & b, [base[f"`{k}`"].eqNullSafe(table[f"`__q_{k}`"]) for k in keys])
    return base.join(table, on, "left").select(*key_cols, *[F.col(f"`{n}`") for n in wanted])


def reduce_column(df: DataFrame, column: str) -> DataFrame:
    """One row: sum, average, minimum, maximum, count (missing values too), median, population deviation."""
    numbers = df.select(c.num(df, column).alias("x"))
    one = numbers.agg(
        F.sum("x").alias("sum"),
        F.avg("x").alias("average"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.count(F.lit(1)).alias("count"),
        F.stddev_pop("x").alias("stdev"),
    )
    middle = ordered.quantiles(numbers, [], ["x"], [0.5]).select(F.col("x__q0").alias("median"))
    return one.select("*", middle.scalar().alias("median"))


def count_if(df: DataFrame, column: str, criterion) -> DataFrame:
    """One row: how many values equal the criterion."""
    return df.agg(F.count_if(F.col(f"`{column}`") == F.lit(criterion)).alias("count_if"))


def unique_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values in ascending order."""
    return df.select(f"`{column}`").distinct().orderBy(F.col(f"`{column}`"))


def drop_missing(df: DataFrame, column: str | None = None) -> DataFrame:
    """Rows without missing values (null or empty text) in the column, or in any column."""
    names = [column] if column else df.columns
    return df.filter(reduce(lambda a, b: a & b, [c.text(n) != "" for n in names]))


def sort_values(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    key = F.col(f"`{column}`")
    return df.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last())


def with_group_totals(df: DataFrame, keys: Sequence[str], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """Group sizes and sums kept on every row: ``totals`` maps a new name to ``(aggregate, column)``."""
    key_cols = {f"__k{i}": F.col(f"`{k}`") for i, k in enumerate(keys)}
    aggs = {name: _aggregate(df, agg, column, ()) for name, (agg, column) in totals.items()}
    out = keyed.attach(df, key_cols, keyed.group_stats(df, key_cols, aggs))
    return out.drop("__weight", "__keep")
