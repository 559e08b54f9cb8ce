"""Default values for missing ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fill_defaults(df: DataFrame) -> DataFrame:
    """Missing values replaced: numbers (also NaN, infinite) 0, booleans false, text ""; dates stay."""
    out = {}
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            usable = ~F.isnan(value) & (F.abs(value) != float("inf"))
            out[field.name] = F.coalesce(F.when(usable, value), F.lit(0).cast(field.dataType))
        elif isinstance(field.dataType, T.NumericType):
            out[field.name] = F.coalesce(value, F.lit(0).cast(field.dataType))
        elif isinstance(field.dataType, T.BooleanType):
            out[field.name] = F.coalesce(value, F.lit(False))
        elif isinstance(field.dataType, T.StringType):
            out[field.name] = F.coalesce(value, F.lit(""))
    return df.withColumns(out) if out else df
