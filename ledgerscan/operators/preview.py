"""Looking into a dataset: search, smart sort, pages."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscan.functions import coerce as c
from ledgerscan.plans.ordered import OrderedRows

SORT_AS_TYPE_SHARE = 0.75
#: Pages that end within so many rows are a bounded top-k in one task.
SHALLOW = 10_000


def _has_text(column: str, query: str) -> Column:
    return F.lower(c.text(column)).contains(query.lower())


def search(df: DataFrame, filters: dict[str, str] | None = None, anywhere: str = "") -> DataFrame:
    """Rows containing every filter text in its column, and ``anywhere`` in at least one column."""
    tests = [
        _has_text(n, q.strip()) for n, q in (filters or {}).items() if n in df.columns and q and q.strip()
    ]
    if anywhere and anywhere.strip():
        tests.append(reduce(lambda a, b: a | b, [_has_text(n, anywhere.strip()) for n in df.columns]))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def sort_key(df: DataFrame, column: str) -> Column:
    """Number if at least 75 % of the values parse, else date if 75 % parse, else lower-case text."""
    dtype = df.schema[column].dataType
    raw = F.col(f"`{column}`")
    if c.is_numeric(dtype) or c.is_datetime(dtype):
        return raw
    plain = F.when(raw.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), raw.try_cast("double"))
    date = c.timestamp_from_text(raw)
    shares = df.agg(
        F.avg(F.when(plain.isNotNull(), 1.0).otherwise(0.0)).alias("numbers"),
        F.avg(F.when(date.isNotNull(), 1.0).otherwise(0.0)).alias("dates"),
    ).first()
    if (shares["numbers"] or 0) >= SORT_AS_TYPE_SHARE:
        return plain
    if (shares["dates"] or 0) >= SORT_AS_TYPE_SHARE:
        return date
    return F.lower(c.text(raw))


def smart_sort(df: DataFrame, column: str, ascending: bool = True, order_by: Sequence[str] = ()) -> DataFrame:
    """Sorted by what the column holds; missing values last, ties by ``order_by``."""
    key = sort_key(df, column)
    ties = [F.col(f"`{o}`") for o in order_by]
    return df.orderBy(key.asc_nulls_last() if ascending else key.desc_nulls_last(), *ties)


def page(
    df: DataFrame,
    page: int = 0,
    per: int = 100,
    filters: dict[str, str] | None = None,
    anywhere: str = "",
    sort_by: str | None = None,
    ascending: bool = True,
    order_by: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """One page of the searched, sorted rows, and a one-row table with their total.

    Rows that ``sort_by`` and ``order_by`` leave in a tie stand in the order of their whole content, so
    pages never overlap or miss a row. A page within the first ``SHALLOW`` rows is a bounded top-k;
    a deeper one comes from rows that are range-partitioned by the order and counted, of which only the
    ranges of the page are read: no task holds the rows in front of it.
    """
    found = search(df, filters, anywhere)
    order = []
    if sort_by:
        key = sort_key(found, sort_by)
        order.append(key.asc_nulls_last() if ascending else key.desc_nulls_last())
    order += [F.col(f"`{o}`") for o in order_by]
    taken = {sort_by, *order_by} if order_by else set()
    order += [F.col(f"`{f.name}`") if f.dataType.typeName() not in ("map", "variant") else F.to_json(f"`{f.name}`") for f in found.schema.fields if f.name not in taken]
    total = found.agg(F.count(F.lit(1)).alias("total"))
    if (page + 1) * per <= SHALLOW:
        return found.orderBy(*order).offset(page * per).limit(per), total
    placed = OrderedRows(found, order).with_place("__place")
    rows = placed.filter(F.col("__place").between(page * per + 1, (page + 1) * per)).orderBy("__place")
    return rows.select([F.col(f"`{n}`") for n in found.columns]), total
