"""Manual filter operators: one condition on one column, lists of conditions, nested groups.

Almost every operator is a plain boolean ``Column``. The few that look beyond the row (top-n,
first-n-days, seen-more-than-once) use a one-row scalar subquery or a per-key count.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscan.functions import coerce as c
from ledgerscan.plans import select, keyed

MAX_DEPTH = 5
RANDOM_SEED = 42

# Day names accepted by the weekday operator.
WEEKDAY_NAMES = {
    "pazartesi": 0,
    "sali": 1,
    "salı": 1,
    "carsamba": 2,
    "çarşamba": 2,
    "persembe": 3,
    "perşembe": 3,
    "cuma": 4,
    "cumartesi": 5,
    "pazar": 6,
}

_fresh = itertools.count()


@dataclass(frozen=True)
class Condition:
    """One test. ``column`` is a column name, or use :func:`test_of` for a computed column."""

    column: str
    operator: str = "contains"
    value: object = ""
    value2: object = ""
    values: object = None
    dtype: str = ""
    case_sensitive: bool = False
    enabled: bool = True
    options: dict = field(default_factory=dict)


class _Subject:
    """The column under test with its lazily built readings."""

    def __init__(self, df, source, cond: Condition, order_by, as_of):
        self.df, self.source, self.cond, self.order_by = df, source, cond, list(order_by)
        self.dtype = c.column_type(df, source)
        self.raw = F.col(f"`{source}`") if isinstance(source, str) else source
        self.as_of = F.current_date() if as_of is None else c.day(c.date_literal(as_of))

    @property
    def text(self) -> Column:
        return c.text(self.raw)

    @property
    def cased(self) -> Column:
        return self.text if self.cond.case_sensitive else F.lower(self.text)

    @property
    def comparable(self) -> Column:
        """The text to compare with a non-empty needle: the bare column if its case counts."""
        if self.cond.case_sensitive and self.needle and isinstance(self.dtype, T.StringType):
            return self.raw
        return self.cased

    @property
    def needle(self) -> str:
        v = str(self.cond.value)
        return v if self.cond.case_sensitive else v.lower()

    @property
    def number(self) -> Column:
        return c.number(self.raw, self.dtype)

    @property
    def target(self) -> Column:
        return self.literal(c.float_param(self.cond.value))

    def literal(self, value: float | None) -> Column:
        """A number to compare with: whole for a whole-number column, so that no cast hides the column."""
        if isinstance(self.dtype, T.IntegralType) and value is not None and value.is_integer() and abs(value) < 2**53:
            return F.lit(int(value))
        return F.lit(value).cast("double")

    @property
    def moment(self) -> Column:
        return c.moment(self.raw, self.dtype)

    @property
    def day(self) -> Column:
        return c.day(self.moment)

    def date_value(self) -> Column:
        return c.date_literal(self.cond.value)

    def list_values(self) -> list[str]:
        o = self.cond.options
        given = self.cond.value if self.cond.values is None else self.cond.values
        return c.value_list(
            given, o.get("trim", True), o.get("drop_empty", True), o.get("dedupe", True), o.get("ignore_case", True)
        )

    def whole(self, default: int, least: int) -> int:
        v = self.cond.value
        return max(least, int(float(v if v not in ("", None, 0) else default)))


def date_range(ts: Column, start, end, ignore_time: bool = True) -> Column:
    """Inclusive range; reversed bounds are swapped, an unreadable bound matches nothing."""
    a, b = c.date_literal(start), c.date_literal(end)
    low, high = F.least(a, b), F.greatest(a, b)
    both = a.isNotNull() & b.isNotNull()
    if not ignore_time:
        return both & (ts >= low) & (ts <= high)
    # whole days as a half-open range of the bare timestamp, which file scans can use
    first, after = c.day(low).cast("timestamp_ntz"), F.date_add(c.day(high), 1).cast("timestamp_ntz")
    return both & (ts >= first) & (ts < after)


def best_rows(df: DataFrame, key: Column, n: int, order_by: Sequence[str], largest: bool) -> Column:
    """Rows among the first ``n`` by ``key`` (ties by ``order_by``), as a comparison with the n-th row.

    The n-th row comes from a bounded top-k (``select.SMALL`` rows at most), handed over as a scalar
    subquery; for a larger n it is selected by counting, while the query is built.
    """
    if not order_by:
        raise ValueError("top-n operators need order_by columns to break ties")
    if n > select.SMALL:
        last = select.nth_row(df, key, order_by, n, largest)
        return key.isNotNull() if last is None else key.isNotNull() & select.up_to(last, key, order_by, largest, df.schema)
    ties = F.struct(*[F.col(f"`{o}`") for o in order_by])
    ordered = df.select(key.alias("key"), ties.alias("tie")).filter("key is not null")
    ordered = ordered.orderBy(F.desc("key") if largest else F.asc("key"), F.asc("tie")).limit(n)
    last = ordered.select(F.struct(F.col("key") if not largest else -F.col("key"), F.col("tie")).alias("at"))
    bound = last.agg(F.max("at").alias("at")).scalar()
    mine = F.struct((-key if largest else key).alias("key"), ties.alias("tie"))
    return key.isNotNull() & (mine <= bound)


def sampled_rows(df: DataFrame, n: int, order_by: Sequence[str], seed: int = RANDOM_SEED) -> Column:
    """A repeatable sample of ``n`` rows: the smallest digests of the row key and the seed."""
    if not order_by:
        raise ValueError("sampling needs order_by columns that identify a row")
    digest = F.md5(F.concat_ws("|", *[F.col(f"`{o}`").cast("string") for o in order_by], F.lit(str(seed))))
    if n > select.SMALL:
        # the first 15 digits of the digest as a number, then the whole digest, then the row
        number, rows = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), df.withColumn("__digest", digest)
        last = select.nth_row(rows, number, ["__digest", *order_by], n, largest=False)
        if last is None:
            return F.lit(True)
        bound = F.struct(F.lit(last["__digest"]).alias("digest"), F.struct(*[F.lit(last[o]).cast(df.schema[o].dataType).alias(o) for o in order_by]).alias("tie"))
        return F.struct(digest.alias("digest"), F.struct(*[F.col(f"`{o}`") for o in order_by]).alias("tie")) <= bound
    ties = F.struct(*[F.col(f"`{o}`") for o in order_by])
    first = df.select(F.struct(digest.alias("digest"), ties.alias("tie")).alias("at")).orderBy("at").limit(n)
    bound = first.agg(F.max("at").alias("at")).scalar()
    return F.struct(digest.alias("digest"), ties.alias("tie")) <= bound


def _number(test: Callable[[Column, _Subject], Column]) -> Callable[[_Subject], Column]:
    """A comparison of the coerced number.

    On a double column the bare column is compared and the valid range tested beside it (that range
    also leaves out NaN), so that both reach the file scan as pushed filters.
    """

    def build(s: _Subject) -> Column:
        if isinstance(s.dtype, T.IntegralType):
            return test(s.raw, s)
        if isinstance(s.dtype, T.DoubleType):
            return test(s.raw, s) & s.raw.between(-c.NUMERIC_ABS_LIMIT, c.NUMERIC_ABS_LIMIT)
        return test(s.number, s)

    return build


def _contains(s: _Subject) -> Column:
    return s.cased.contains(s.needle)


def _regex(s: _Subject) -> Column:
    flags = "" if s.cond.case_sensitive else "(?iu)"
    return s.text.rlike(flags + str(s.cond.value))


def _equals(s: _Subject) -> Column:
    if s.cond.dtype == "numeric":
        return _number(lambda x, s: x == s.target)(s)
    return s.comparable == s.needle


def _not_equals(s: _Subject) -> Column:
    if s.cond.dtype == "numeric":
        # an unreadable target differs from every number
        return s.number.isNotNull() & F.coalesce(s.number != s.target, F.lit(True))
    return s.cased != s.needle


def _in(s: _Subject) -> Column:
    values = s.list_values()
    if not s.cond.case_sensitive or s.cond.options.get("ignore_case", False):
        return F.lower(s.text).isin([v.lower() for v in values]) if values else F.lit(False)
    return s.text.isin(values) if values else F.lit(False)


def _between(s: _Subject) -> Column:
    low, high = c.float_param(s.cond.value), c.float_param(s.cond.value2)
    if low is None or high is None:
        return F.lit(False)
    return _number(lambda x, s: x.between(s.literal(min(low, high)), s.literal(max(low, high))))(s)


def _num_in(s: _Subject) -> Column:
    wanted = [v for v in (c.float_param(x) for x in s.list_values()) if v is not None]
    return _number(lambda x, s: x.isin([s.literal(v) for v in wanted]))(s) if wanted else F.lit(False)


def _not(build: Callable[[_Subject], Column]) -> Callable[[_Subject], Column]:
    return lambda s: ~F.coalesce(build(s), F.lit(False))


def _week(s: _Subject, offset: int) -> Column:
    monday = F.date_add(s.as_of, offset * 7 - F.weekday(s.as_of))
    start = monday.cast("timestamp_ntz")
    end = F.timestamp_add("SECOND", F.lit(7 * 86400 - 1), start)
    return s.moment.between(start, end)


def _same_month(s: _Subject, months_back: int) -> Column:
    return F.trunc(s.day, "MM") == F.trunc(F.add_months(s.as_of, -months_back), "MM")


def _last_n_days(s: _Subject) -> Column:
    n = s.whole(0, 0)
    return s.moment.between(
        F.date_sub(s.as_of, n).cast("timestamp_ntz"), F.date_add(s.as_of, 1).cast("timestamp_ntz")
    )


def _first_n_days(s: _Subject) -> Column:
    first = s.df.agg(F.min(s.moment).alias("first")).scalar()
    return s.moment.between(first, F.timestamp_add("DAY", F.lit(s.whole(1, 1) - 1), first))


def _weekday(s: _Subject) -> Column:
    wanted = str(s.cond.value).strip().lower()
    index = WEEKDAY_NAMES.get(wanted)
    if index is None:
        number = c.float_param(s.cond.value)
        index = None if number is None else int(number)
    return F.lit(False) if index is None else F.weekday(s.moment) == index


def _part(extract) -> Callable[[_Subject], Column]:
    def build(s: _Subject) -> Column:
        wanted = c.float_param(s.cond.value)
        return F.lit(False) if wanted is None else extract(s.moment) == int(wanted)

    return build


OPERATORS: dict[str, Callable[[_Subject], Column]] = {
    "contains": _contains,
    "not_contains": _not(_contains),
    "equals": _equals,
    "not_equals": _not_equals,
    "starts": lambda s: s.comparable.startswith(s.needle),
    "ends": lambda s: s.comparable.endswith(s.needle),
    "regex": _regex,
    "regex_not": _not(_regex),
    "in": _in,
    "not_in": _not(_in),
    "is_empty": lambda s: s.text == "",
    "not_empty": lambda s: s.text != "",
    "len_eq": lambda s: F.length(s.text) == int(float(s.cond.value)),
    "len_lt": lambda s: F.length(s.text) < int(float(s.cond.value)),
    "len_gt": lambda s: F.length(s.text) > int(float(s.cond.value)),
    "gt": _number(lambda x, s: x > s.target),
    "gte": _number(lambda x, s: x >= s.target),
    "lt": _number(lambda x, s: x < s.target),
    "lte": _number(lambda x, s: x <= s.target),
    "between": _between,
    "not_between": _not(_between),
    "num_in": _num_in,
    "num_not_in": _not(_num_in),
    "zero": _number(lambda x, s: x == 0),
    "non_zero": _number(lambda x, s: x != 0),
    "positive": _number(lambda x, s: x > 0),
    "negative": _number(lambda x, s: x < 0),
    "top_n": lambda s: best_rows(s.df, s.number, s.whole(10, 1), s.order_by, largest=True),
    "bottom_n": lambda s: best_rows(s.df, s.number, s.whole(10, 1), s.order_by, largest=False),
    "random_n": lambda s: sampled_rows(s.df, s.whole(10, 1), s.order_by),
    "date_eq": lambda s: s.day == c.day(s.date_value()),
    "date_equals": lambda s: s.day == c.day(s.date_value()),
    "date_before": lambda s: s.moment < s.date_value(),
    "date_after": lambda s: s.moment > s.date_value(),
    "date_on_or_after": lambda s: s.moment >= s.date_value(),
    "date_on_or_before": lambda s: s.moment <= s.date_value(),
    "month": _part(F.month),
    "year": _part(F.year),
    "date_between": lambda s: date_range(
        s.moment, s.cond.value, s.cond.value2, s.cond.options.get("ignore_time", True)
    ),
    "today": lambda s: s.day == s.as_of,
    "yesterday": lambda s: s.day == F.date_sub(s.as_of, 1),
    "this_week": lambda s: _week(s, 0),
    "last_week": lambda s: _week(s, -1),
    "this_month": lambda s: _same_month(s, 0),
    "last_month": lambda s: _same_month(s, 1),
    "this_year": lambda s: F.year(s.moment) == F.year(s.as_of),
    "last_year": lambda s: F.year(s.moment) == F.year(s.as_of) - 1,
    "last_n_days": _last_n_days,
    "first_n_days": _first_n_days,
    "weekday": _weekday,
    "weekend": lambda s: F.weekday(s.moment) >= 5,
    "is_true": lambda s: F.lower(c.strip(s.text)).isin(c.TRUE_WORDS),
    "is_false": lambda s: F.lower(c.strip(s.text)).isin(c.FALSE_WORDS),
}

# These need a per-key count joined to the rows.
COUNTING_OPERATORS = {"duplicate": "__weight > 1", "unique": "__weight = 1"}


def test_of(df: DataFrame, source: str | Column, cond: Condition, order_by=(), as_of=None) -> Column:
    """Boolean column of a condition on a named or computed column; null counts as false."""
    if not cond.enabled:
        return F.lit(True)
    if cond.operator not in OPERATORS:
        raise ValueError(f"Unsupported filter operator: {cond.operator}")
    return OPERATORS[cond.operator](_Subject(df, source, cond, order_by, as_of))


def mask_of(df: DataFrame, source: str | Column, cond: Condition, order_by=(), as_of=None) -> Column:
    """The same, never null."""
    return F.coalesce(test_of(df, source, cond, order_by, as_of), F.lit(False))


def with_condition(
    df: DataFrame, cond: Condition, order_by=(), as_of=None, base: DataFrame | None = None
) -> tuple[DataFrame, Column]:
    """``df`` (with a helper column if the operator needs one) and the test, where null counts as false.

    Tests are only combined by AND and OR, so a bare test filters like its never-null form, and
    comparisons can be pushed into the scan. ``base`` is the table without helper columns of earlier conditions; statistics come from it.
    """
    base = df if base is None else base
    if cond.column not in df.columns:
        raise ValueError(f"Column not found: {cond.column}")
    if cond.enabled and cond.operator in COUNTING_OPERATORS:
        flag = f"__seen_{next(_fresh)}"
        key = {"__key": F.col(f"`{cond.column}`")}
        stats = keyed.group_stats(base, key, {})
        out = keyed.attach(df, key, stats).withColumn(flag, F.expr(COUNTING_OPERATORS[cond.operator])).drop("__weight", "__keep")
        return out, F.col(flag)
    return df, test_of(base, cond.column, cond, order_by, as_of)


def where_conditions(
    df: DataFrame, conditions: Sequence[Condition], logic: str = "and", order_by=(), as_of=None
) -> DataFrame:
    """Rows that pass all (or, with ``logic="or"``, any) of the conditions."""
    if not conditions:
        raise ValueError("At least one filter condition is required")
    node = {"logic": logic, "children": list(conditions)}
    return where_tree(df, node, order_by, as_of)


def where_tree(df: DataFrame, node: dict | Condition | None, order_by=(), as_of=None) -> DataFrame:
    """Rows that pass a nested group ``{"logic": "and" | "or", "children": [...]}``."""
    out, mask = _tree(df, node, order_by, as_of, 0, df)
    return out.filter(mask).select(*[F.col(f"`{n}`") for n in df.columns])


def _tree(df, node, order_by, as_of, depth, base) -> tuple[DataFrame, Column]:
    if depth > MAX_DEPTH:
        raise ValueError("Filter group depth limit exceeded")
    if isinstance(node, Condition):
        return with_condition(df, node, order_by, as_of, base)
    children = [child for child in (node or {}).get("children") or [] if child]
    if not children:
        return df, F.lit(True)
    either = str(node.get("logic", "and")).lower() == "or"
    combined = None
    for child in children:
        df, mask = _tree(df, child, order_by, as_of, depth + 1, base)
        combined = mask if combined is None else (combined | mask if either else combined & mask)
    return df, combined


def where_formula(df: DataFrame, formula: Column | str) -> DataFrame:
    """Rows for which a boolean Column or SQL expression is true (null counts as false)."""
    return df.filter(F.expr(formula) if isinstance(formula, str) else formula)
