"""What the checks share: the request, column methods, helper columns, grouped statistics.

A check annotates rows: it adds ``__match`` and, if asked, helper columns that explain the match.
Matching rows, their complement and OR chains all come from that one annotated plan, so none of
them needs a row id or an anti join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscan.functions import coerce as c
from ledgerscan.operators.checks import labels
from ledgerscan.plans import keyed
from ledgerscan.plans.ordered import OrderedRows

MATCH = "__match"
SEPARATOR = "\u001f"

HELPER_COLUMNS = [
    "matched_column", "matched_value", "match_reason", "check_name", "check_result", "group_count", "group_id",
    "risk_level", "account_combo", "group_total", "digit_share", "risk_score", "review_note", "debit_total",
    "credit_total", "difference", "CALC_DEBIT", "CALC_CREDIT",
]


@dataclass
class Check:
    """One check request on ``df``."""

    df: DataFrame
    check: str
    columns: list[str]
    method: str = "any"
    name: str = ""
    helpers: bool = True
    order_by: Sequence[str] = ()
    as_of: object = None
    matched_only: bool = False
    params: dict = field(default_factory=dict)
    base: DataFrame | None = None

    @property
    def source(self) -> DataFrame:
        """Where statistics over all rows come from: ``df``, or the plain table whose rows ``df`` annotates."""
        return self.df if self.base is None else self.base

    def param(self, key: str, default=None):
        value = self.params.get(key)
        return default if value is None or value == "" else value

    def number(self, key: str, default: float) -> float:
        return float(c.float_param(self.param(key), default))

    def whole(self, key: str, default: int) -> int:
        return int(self.number(key, default))

    def column(self, key: str, position: int | None = None) -> str | None:
        """Column named by a parameter, else the one at ``position`` of the chosen columns."""
        name = self.param(key)
        if name is None and position is not None and position < len(self.columns):
            name = self.columns[position]
        return name if name in self.df.columns else None

    def required(self, key: str, position: int | None = None) -> str:
        name = self.column(key, position)
        if name is None:
            raise ValueError(f"{self.check}: column parameter {key} is missing")
        return name

    def num(self, name: str) -> Column:
        return c.num(self.df, name)

    def moment(self, name: str) -> Column:
        return c.when_(self.df, name)

    def today(self) -> Column:
        return F.localtimestamp() if self.as_of is None else c.date_literal(self.as_of)

    def with_df(self, df: DataFrame) -> Check:
        return replace(self, df=df)


def combine(masks: Sequence[Column], method: str) -> Column:
    """AND for ``all``/``all_match``, OR for every other method."""
    if not masks:
        return F.lit(False)
    if method in ("all", "all_match"):
        return reduce(lambda a, b: a & b, masks)
    return reduce(lambda a, b: a | b, masks)


@dataclass
class Tested:
    """One tested column: label, boolean result, value shown to the user."""

    label: str
    mask: Column
    value: Column


def text_subjects(req: Check) -> list[tuple[str, Column]]:
    """Texts to test: each column, or the single combined / first non-empty text."""
    trim = req.params.get("trim", True)
    if req.method == "combined_text":
        parts = [F.nullif(c.normalized(n, trim), F.lit("")) for n in req.columns]
        return [(labels.COMBINED_COLUMN, F.concat_ws(req.params.get("separator", " "), *parts))]
    if req.method == "first_non_empty":
        parts = [F.nullif(c.normalized(n, trim), F.lit("")) for n in req.columns]
        return [(labels.COMBINED_COLUMN, F.coalesce(*parts, F.lit("")))]
    return [(n, F.col(f"`{n}`")) for n in req.columns]


def number_subjects(req: Check) -> list[tuple[str, Column]]:
    """Numbers to test: each column, or the row sum / row difference."""
    numbers = [req.num(n) for n in req.columns]
    if req.method == "row_sum":
        return [(labels.ROW_SUM_COLUMN, reduce(lambda a, b: a + b, numbers))]
    if req.method == "row_diff" and len(numbers) >= 2:
        return [(labels.ROW_DIFF_COLUMN, reduce(lambda a, b: a - b, numbers))]
    return list(zip(req.columns, numbers, strict=True))


def row_result(
    req: Check, tested: Sequence[Tested], reason: str, match: Callable[[list[Column]], Column] | None = None
) -> DataFrame:
    """Annotated rows of a check that looks at one row at a time.

    When only matches are wanted, the bare tests filter first: they can be pushed into the scan.
    """
    if req.matched_only and match is None:
        req = req.with_df(req.df.filter(combine([t.mask for t in tested], req.method)))
    flags = [f"__m{i}" for i in range(len(tested))]
    values = [f"__v{i}" for i in range(len(tested))]
    out = req.df.select(
        "*",
        *[F.coalesce(t.mask, F.lit(False)).alias(f) for t, f in zip(tested, flags, strict=True)],
        *([t.value.alias(v) for t, v in zip(tested, values, strict=True)] if req.helpers else []),
    )
    masks = [F.col(f) for f in flags]
    out = out.withColumn(MATCH, combine(masks, req.method) if match is None else match(masks))
    if req.helpers:
        first = F.coalesce(*[F.when(m, F.lit(t.label)) for m, t in zip(masks, tested, strict=True)], F.lit(""))
        shown = F.coalesce(*[F.when(m, c.text(F.col(v))) for m, v in zip(masks, values, strict=True)], F.lit(""))
        out = out.withColumns(
            {
                "matched_column": first,
                "matched_value": shown,
                "match_reason": F.lit(reason),
                "check_name": F.lit(req.name),
                "check_result": F.when(reduce(lambda a, b: a | b, masks), F.lit(labels.MATCHED)).otherwise(
                    F.lit(labels.LOOKED_AT)
                ),
            }
        )
    return out.drop(*flags, *values)


def simple_result(req: Check, match: Column, helpers: dict[str, Column]) -> DataFrame:
    """Annotated rows with ready-made helper columns."""
    df = req.df.filter(match) if req.matched_only else req.df
    out = df.withColumn(MATCH, F.coalesce(match, F.lit(False)))
    if req.helpers:
        out = out.withColumns({"check_name": F.lit(req.name), **helpers})
    return out


def text_key(columns: Sequence[Column]) -> dict[str, Column]:
    """Composite text key of at most 64 characters.

    Short keys stay as they are; a longer one is replaced by its 64-digit digest, so that long texts
    are neither shuffled nor broadcast. The lengths differ, so the two kinds cannot meet.
    """
    joined = F.concat_ws(SEPARATOR, *columns)
    return {"__key": F.when(F.length(joined) < 64, joined).otherwise(F.sha2(joined, 256))}


def grouped_result(
    req: Check,
    keys: dict[str, Column],
    aggs: dict[str, Column],
    group_condition: Column,
    helpers: dict[str, Column],
    row_condition: Column | None = None,
    numbered: bool = False,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Annotated rows of a check on per-key statistics (``__weight`` = rows of the key), ``aggs`` or ready ``stats``.

    With ``numbered`` and an ``order_by``, keys are numbered by first appearance (``group_id``).
    """
    numbered = numbered and req.helpers and bool(req.order_by)
    if numbered:
        aggs = {**aggs, "__first": F.min(keyed.order_key(req.order_by))}
    stats = keyed.group_stats(req.source, keys, aggs) if stats is None else stats
    aggs = {n: n for n in stats.columns if n not in keys}
    if numbered:
        positions = OrderedRows(stats, ["__first"]).with_position("__group_id")
        stats = positions.drop("__bucket", "__at")
    out = keyed.attach(req.df, keys, stats, keep=group_condition if req.matched_only else None)
    match = group_condition if row_condition is None else group_condition & row_condition
    out = out.withColumn(MATCH, F.coalesce(match, F.lit(False)))
    if req.helpers:
        if numbered:
            helpers = {**helpers, "group_id": F.col("__group_id")}
        out = out.withColumns({"check_name": F.lit(req.name), **helpers})
    extra = [*aggs, "__weight", "__keep", "__group_id"]
    return out.drop(*extra)
