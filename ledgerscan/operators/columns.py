"""Column tools: drop, rename, constants, formulas, fill, cast, and step lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscan.functions import coerce as c
from ledgerscan.functions import logic, rowstats


def drop(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def add_constant(df: DataFrame, new_col: str, value="") -> DataFrame:
    if not new_col.strip():
        raise ValueError("New column name is required")
    return df.withColumn(new_col, F.lit(value))


def safe_name(name: str) -> str:
    """Identifier under which a column can be written in a formula without quoting."""
    ident = re.sub(r"\W+", "_", name).strip("_")
    return f"col_{ident}" if not ident or ident[0].isdigit() else ident


def with_formula(df: DataFrame, new_col: str, formula: Column | str, numeric: bool = True) -> DataFrame:
    """Adds a Column, or a SQL expression in which bare column names read as coerced numbers.

    Inside SQL text a column is known by its name and by its :func:`safe_name`; ``numeric=False``
    leaves the values as they are.
    """
    if isinstance(formula, Column):
        return df.withColumn(new_col, formula)
    names = df.columns
    readings = {n: c.num(df, n) if numeric else F.col(f"`{n}`") for n in names}
    for n in names:
        readings.setdefault(safe_name(n), readings[n])
    stored = [F.col(f"`{n}`").alias(f"__own_{i}") for i, n in enumerate(names)]
    scope = df.select(*stored, *[v.alias(k) for k, v in readings.items()])
    own = [F.col(f"__own_{i}").alias(n) for i, n in enumerate(names) if n != new_col]
    return scope.select(*own, F.expr(formula).alias(new_col))


def fillna(df: DataFrame, cols: Sequence[str], value="") -> DataFrame:
    """Missing values (null, and empty text) replaced by a constant."""
    if not cols:
        raise ValueError("Select at least one column")
    return df.withColumns(
        {n: logic.filled(F.col(f"`{n}`"), df.schema[n].dataType, value, empty_is_missing=True) for n in cols}
    )


def typecast(df: DataFrame, cols: Sequence[str], dtype: str = "string") -> DataFrame:
    if not cols:
        raise ValueError("Select at least one column")
    read = {"numeric": c.num, "datetime": c.when_}.get(dtype, lambda d, n: F.col(f"`{n}`").cast("string"))
    return df.withColumns({n: read(df, n) for n in cols})


def fill_column(df: DataFrame, column: str, value="0", new_column: str = "filled_column") -> DataFrame:
    filled = logic.filled(F.col(f"`{column}`"), df.schema[column].dataType, value, empty_is_missing=False)
    return df.withColumn(new_column, filled)


def upper_column(df: DataFrame, column: str, new_column: str = "upper_column") -> DataFrame:
    return df.withColumn(new_column, F.upper(c.text(column)))


def sum_columns(df: DataFrame, columns: Sequence[str], new_column: str = "total") -> DataFrame:
    """Row sum over the numeric ones among the columns."""
    numeric = [F.col(f"`{n}`").cast("double") for n in columns if c.is_numeric(df.schema[n].dataType)]
    return df.withColumn(new_column, rowstats.row_sum(numeric) if numeric else F.lit(0.0))


STEPS: dict[str, Callable[..., DataFrame]] = {
    "pd_fillna": fill_column,
    "pd_upper": upper_column,
    "pd_sum": sum_columns,
}


def run_steps(df: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """A list of ``{"formula_id": ..., "params": {...}}`` applied in order."""

    def apply(current: DataFrame, step: dict) -> DataFrame:
        if step["formula_id"] not in STEPS:
            raise ValueError(f"Unknown formula: {step['formula_id']}")
        return current.transform(STEPS[step["formula_id"]], **step.get("params", {}))

    return reduce(apply, steps, df)
