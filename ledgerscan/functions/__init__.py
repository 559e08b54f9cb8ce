"""Spreadsheet-style column functions by id, and the formula builtins.

``apply_function(df, "excel_roundup", ["amount"], decimals=2)`` adds one column. Numbers, dates and
text are coerced from whatever type the column has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscan.functions import coerce as c
from ledgerscan.functions import dates, logic, maths, ordered, rowstats, texts


@dataclass
class Call:
    """One function call on ``df``: chosen columns and arguments."""

    df: DataFrame
    cols: Sequence[str | Column]
    args: dict = field(default_factory=dict)
    as_of: object = None

    def raw(self, i: int = 0) -> Column:
        v = self.cols[i]
        return F.col(f"`{v}`") if isinstance(v, str) else v

    @property
    def x(self) -> Column:
        return c.num(self.df, self.cols[0])

    @property
    def y(self) -> Column:
        return c.num(self.df, self.cols[1])

    @property
    def xs(self) -> list[Column]:
        return [c.num(self.df, v) for v in self.cols]

    @property
    def t(self) -> Column:
        return c.text(self.raw())

    @property
    def ts(self) -> list[Column]:
        return [c.text(self.raw(i)) for i in range(len(self.cols))]

    @property
    def d(self) -> Column:
        return self.date(0)

    def date(self, i: int) -> Column:
        if i >= len(self.cols):
            raise ValueError("two date columns are needed")
        return c.when_(self.df, self.cols[i])

    @property
    def flags(self) -> list[Column]:
        return [c.truthy(self.raw(i), c.column_type(self.df, v)) for i, v in enumerate(self.cols)]

    def int(self, key: str, default: int) -> int:
        v = c.float_param(self.args.get(key), default)
        return int(v)

    def float(self, key: str, default: float) -> float:
        return float(c.float_param(self.args.get(key), default))

    def str(self, key: str, default: str = "") -> str:
        return str(self.args.get(key, default))

    def second_or(self, key: str, default: float) -> Column | float:
        return self.y if len(self.cols) > 1 else self.float(key, default)

    def now(self) -> Column:
        return F.localtimestamp() if self.as_of is None else c.date_literal(self.as_of)


def _datetime_part(part) -> Callable[[Call], Column]:
    return lambda k: part(k.d)


def _number(f) -> Callable[[Call], Column]:
    return lambda k: f(k.x)


def _row(f, *extra) -> Callable[[Call], Column]:
    return lambda k: f(k.xs, *extra)


def _fill(empty_is_missing: bool, key: str) -> Callable[[Call], Column]:
    return lambda k: logic.filled(k.raw(), c.column_type(k.df, k.cols[0]), k.args.get(key, ""), empty_is_missing)


FUNCTIONS: dict[str, Callable[[Call], Column]] = {
    # several columns of one row
    "excel_sum": _row(rowstats.row_sum),
    "excel_product": _row(rowstats.row_product),
    "excel_sumsq": _row(rowstats.row_sumsq),
    "excel_average": _row(rowstats.row_mean),
    "np_mean": _row(rowstats.row_mean),
    "excel_median": _row(rowstats.row_median),
    "excel_min": _row(rowstats.row_min),
    "excel_max": _row(rowstats.row_max),
    "excel_count": lambda k: rowstats.row_count([k.raw(i) for i in range(len(k.cols))]),
    "excel_counta": lambda k: rowstats.text_count(k.ts, blank=False),
    "excel_countblank": lambda k: rowstats.text_count(k.ts, blank=True),
    "excel_stdev_p": _row(rowstats.row_std, 0),
    "np_std": _row(rowstats.row_std, 0),
    "excel_stdev_s": _row(rowstats.row_std, 1),
    "excel_var_p": _row(rowstats.row_var, 0),
    "excel_var_s": _row(rowstats.row_var, 1),
    "excel_percentile_inc": lambda k: rowstats.row_percentile(k.xs, k.float("q", 0.5)),
    "np_percentile": lambda k: rowstats.row_percentile(k.xs, k.float("q", 0.5)),
    "excel_quartile_inc": lambda k: rowstats.row_percentile(k.xs, k.int("quart", 2) / 4),
    "excel_large": lambda k: rowstats.row_large(k.xs, k.int("k", 1)),
    "excel_small": lambda k: rowstats.row_small(k.xs, k.int("k", 1)),
    "excel_devsq": _row(rowstats.row_devsq),
    "excel_geomean": _row(rowstats.row_geomean),
    "excel_harmean": _row(rowstats.row_harmean),
    "excel_skew": _row(rowstats.row_skew),
    "excel_kurt": _row(rowstats.row_kurt),
    "excel_gcd": _row(rowstats.row_gcd),
    "excel_lcm": _row(rowstats.row_lcm),
    # one number
    "excel_abs": _number(F.abs),
    "excel_round": lambda k: maths.half_even(k.x, k.int("decimals", 0)),
    "excel_roundup": lambda k: maths.round_up(k.x, k.int("decimals", 0)),
    "excel_rounddown": lambda k: maths.round_down(k.x, k.int("decimals", 0)),
    "excel_int": _number(maths.floor),
    "excel_trunc": lambda k: maths.truncate(k.x, k.int("decimals", 0)),
    "excel_ceiling": lambda k: maths.ceiling(k.x, k.float("significance", 1.0)),
    "excel_floor": lambda k: maths.floor_to(k.x, k.float("significance", 1.0)),
    "excel_even": _number(maths.even),
    "excel_odd": _number(maths.odd),
    "excel_mod": lambda k: maths.mod(k.x, k.second_or("divisor", 1.0)),
    "excel_power": lambda k: maths.power(k.x, k.second_or("power", 2.0)),
    "np_power": lambda k: maths.power(k.x, k.second_or("power", 2.0)),
    "excel_sqrt": _number(maths.sqrt),
    "np_sqrt": _number(maths.sqrt),
    "excel_exp": _number(maths.exp),
    "excel_ln": _number(maths.ln),
    "np_log": _number(maths.ln),
    "excel_log": lambda k: maths.log(k.x, k.float("base", 10.0)),
    "excel_log10": _number(maths.log10),
    "excel_sign": _number(F.signum),
    "excel_pi": lambda k: F.pi(),
    "excel_radians": _number(F.radians),
    "excel_degrees": _number(F.degrees),
    "excel_sin": _number(F.sin),
    "excel_cos": _number(F.cos),
    "excel_tan": _number(F.tan),
    "excel_asin": _number(maths.asin),
    "excel_acos": _number(maths.acos),
    "excel_atan": _number(F.atan),
    "excel_atan2": lambda k: F.atan2(k.x, k.y),
    "excel_sinh": _number(F.sinh),
    "excel_cosh": _number(F.cosh),
    "excel_tanh": _number(F.tanh),
    "excel_asinh": _number(F.asinh),
    "excel_acosh": _number(maths.acosh),
    "excel_atanh": _number(maths.atanh),
    "excel_cot": lambda k: maths.reciprocal(F.tan(k.x)),
    "excel_sec": lambda k: maths.reciprocal(F.cos(k.x)),
    "excel_csc": lambda k: maths.reciprocal(F.sin(k.x)),
    "excel_coth": lambda k: maths.reciprocal(F.tanh(k.x)),
    "excel_sech": lambda k: maths.reciprocal(F.cosh(k.x)),
    "excel_csch": lambda k: maths.reciprocal(F.sinh(k.x)),
    "excel_fact": _number(maths.factorial),
    "np_clip": lambda k: maths.clip(k.x, k.float("min", 0), k.float("max", 1)),
    "np_where": lambda k: F.when(k.x > k.float("threshold", 0), F.lit(k.str("true", "True"))).otherwise(
        F.lit(k.str("false", "False"))
    ),
    "excel_iseven": lambda k: F.coalesce(maths.mod(k.x, 2.0) == 0, F.lit(False)),
    "excel_isodd": lambda k: F.coalesce(maths.mod(k.x, 2.0) == 1, F.lit(False)),
    "excel_isnumber": lambda k: k.x.isNotNull(),
    "excel_value": lambda k: k.x,
    "pd_to_numeric": lambda k: k.x,
    # text
    "excel_len": lambda k: F.length(k.t),
    "excel_upper": lambda k: F.upper(k.t),
    "excel_lower": lambda k: F.lower(k.t),
    "excel_trim": lambda k: texts.trimmed(k.t),
    "excel_proper": lambda k: texts.proper(k.t),
    "excel_clean": lambda k: texts.clean(k.t),
    "excel_exact": lambda k: k.ts[0] == k.ts[1] if len(k.cols) > 1 else F.lit(False),
    "excel_find": lambda k: texts.find(k.t, k.str("text")),
    "excel_search": lambda k: texts.find(F.lower(k.t), k.str("text").lower()),
    "excel_replace": lambda k: texts.replace_at(k.t, k.int("start", 1), k.int("length", 1), k.str("new")),
    "excel_substitute": lambda k: texts.substitute(k.t, k.str("old"), k.str("new")),
    "pd_replace": lambda k: texts.substitute(k.t, k.str("old"), k.str("new")),
    "excel_rept": lambda k: F.repeat(k.t, k.int("n", 1)),
    "excel_concat": lambda k: texts.concat(k.ts, k.str("sep")),
    "excel_textjoin": lambda k: texts.join(k.ts, k.str("sep"), k.str("ignore_empty", "true").lower() != "false"),
    "excel_left": lambda k: texts.left(k.t, k.int("n", 1)),
    "excel_mid": lambda k: texts.mid(k.t, k.int("start", 1), k.int("n", 1)),
    "excel_right": lambda k: texts.right(k.t, k.int("n", 1)),
    "pd_contains": lambda k: texts.contains_pattern(k.t, k.str("text")),
    # dates
    "excel_today": lambda k: k.now().cast("date").cast("timestamp_ntz"),
    "excel_now": lambda k: k.now(),
    "excel_year": _datetime_part(F.year),
    "pd_year": _datetime_part(F.year),
    "excel_month": _datetime_part(F.month),
    "pd_month": _datetime_part(F.month),
    "excel_day": _datetime_part(F.dayofmonth),
    "pd_day": _datetime_part(F.dayofmonth),
    "excel_hour": _datetime_part(F.hour),
    "excel_minute": _datetime_part(F.minute),
    "excel_second": _datetime_part(F.second),
    "excel_weekday": _datetime_part(dates.iso_weekday),
    "excel_weeknum": _datetime_part(F.weekofyear),
    "excel_days": lambda k: dates.elapsed_days(k.date(0), k.date(1)),
    "excel_datedif": lambda k: dates.date_difference(k.date(0), k.date(1), k.str("unit", "D")),
    "pd_to_datetime": lambda k: k.d,
    # logic
    "excel_and": lambda k: logic.all_true(k.flags),
    "excel_or": lambda k: logic.any_true(k.flags),
    "excel_not": lambda k: ~k.flags[0],
    "excel_if": lambda k: F.when(k.flags[0], F.lit(k.args.get("true", "True"))).otherwise(
        F.lit(k.args.get("false", "False"))
    ),
    "excel_iferror": _fill(empty_is_missing=False, key="fallback"),
    "excel_isblank": lambda k: k.t == "",
    "pd_fillna": _fill(empty_is_missing=True, key="value"),
    # whole column, as a one-row scalar
    "np_zscore": lambda k: ordered.zscore(k.df, k.cols[0]),
    "excel_correl": lambda k: ordered.correlation(k.df, *k.cols[:2]) if len(k.cols) > 1 else F.lit(None).cast("double"),
    "excel_covariance_p": lambda k: (
        ordered.covariance(k.df, *k.cols[:2]) if len(k.cols) > 1 else F.lit(None).cast("double")
    ),
}

# These add their column through joins or ordered layouts instead of one expression.
ORDERED_FUNCTIONS = {"excel_rank_eq", "pd_rank", "pd_diff", "pd_pct_change", "pd_rolling_mean", "cumsum"}

_WITHOUT_COLUMNS = {"excel_pi", "excel_today", "excel_now"}


def column_function(
    df: DataFrame, fn: str, cols: Sequence[str | Column] | str = (), as_of=None, **args
) -> Column:
    """The Column of a row-wise (or one-row scalar) function."""
    if fn not in FUNCTIONS:
        raise ValueError(f"Unsupported function: {fn}")
    cols = [cols] if isinstance(cols, (str, Column)) else list(cols)
    if not cols and fn not in _WITHOUT_COLUMNS:
        raise ValueError("Select at least one column")
    missing = [v for v in cols if isinstance(v, str) and v not in df.columns]
    if missing:
        raise ValueError(f"Column not found: {', '.join(missing)}")
    return FUNCTIONS[fn](Call(df, cols, args, as_of))


def apply_function(
    df: DataFrame,
    fn: str,
    cols: Sequence[str] | str = (),
    new_col: str | None = None,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    as_of=None,
    **args,
) -> DataFrame:
    """``df`` with one more column computed by a named function."""
    new_col = new_col or f"{fn}_result"
    if fn not in ORDERED_FUNCTIONS:
        return df.withColumn(new_col, column_function(df, fn, cols, as_of, **args))
    column = cols if isinstance(cols, str) else cols[0]
    if fn == "excel_rank_eq":
        ascending = str(args.get("ascending", "false")).lower() == "true"
        return ordered.rank(df, column, new_col, partition_by, ascending)
    if fn == "pd_rank":
        ascending = str(args.get("ascending", "true")).lower() != "false"
        return ordered.rank(df, column, new_col, partition_by, ascending, dense=True)
    if fn == "pd_diff":
        return ordered.difference(df, column, new_col, order_by, partition_by, int(args.get("periods", 1)))
    if fn == "pd_pct_change":
        return ordered.percent_change(df, column, new_col, order_by, partition_by, int(args.get("periods", 1)))
    if fn == "pd_rolling_mean":
        return ordered.rolling_mean(df, column, new_col, order_by, partition_by, int(args.get("window", 3)))
    return ordered.running_sum(df, column, new_col, order_by, partition_by)


class Formula:
    """The formula builtins bound to a table: ``f = Formula(df); df.withColumn("x", f.SUM("a", "b") * 2)``.

    Arguments are column names, Columns or constants.
    """

    def __init__(self, df: DataFrame, as_of=None):
        self.df, self.as_of = df, as_of

    def _value(self, v) -> str | Column:
        if isinstance(v, Column) or (isinstance(v, str) and v in self.df.columns):
            return v
        return F.lit(v)

    def _call(self, fn: str, *values, **args) -> Column:
        return FUNCTIONS[fn](Call(self.df, [self._value(v) for v in values], args, self.as_of))

    def COL(self, name: str) -> Column:
        return F.col(f"`{name}`")

    def NUM(self, v) -> Column:
        return c.num(self.df, self._value(v))

    def TXT(self, v) -> Column:
        return c.text(self._value(v))

    def COUNT(self, *values) -> Column:
        """Values that read as numbers."""
        return rowstats.row_count([self.NUM(v) for v in values])

    def COUNTA(self, *values) -> Column:
        """Values that are not null; empty text counts."""
        return self._call("excel_count", *values)

    def PI(self) -> Column:
        return F.lit(math.pi)

    def IF(self, condition: Column, true_value, false_value="") -> Column:
        values = [v if isinstance(v, Column) else F.lit(v) for v in (true_value, false_value)]
        return F.when(condition, values[0]).otherwise(values[1])

    def IFERROR(self, value, fallback="") -> Column:
        return self._call("excel_iferror", value, fallback=fallback)

    def CONCAT(self, *values, sep: str = "") -> Column:
        return self._call("excel_concat", *values, sep=sep)

    def TEXTJOIN(self, sep: str, *values) -> Column:
        return self._call("excel_textjoin", *values, sep=sep, ignore_empty="false")

    def PERCENTILE_INC(self, q: float, *values) -> Column:
        return self._call("excel_percentile_inc", *values, q=q)

    def QUARTILE_INC(self, quart: float, *values) -> Column:
        return self._call("excel_percentile_inc", *values, q=float(quart) / 4)

    def __getattr__(self, name: str):
        """The builtins that only differ from a named function by their spelling."""
        if name in _SAME_AS_NAMED:
            fn, *keys = _SAME_AS_NAMED[name]

            def call(*values, **args):
                take = len(values) - len(keys) if keys and len(values) > 1 else len(values)
                args.update(zip(keys, values[take:], strict=False))
                return self._call(fn, *values[:take], **args)

            return call
        raise AttributeError(name)


# Builtin -> named function, plus the names of trailing constant arguments.
_SAME_AS_NAMED = {
    "ABS": ("excel_abs",),
    "SUM": ("excel_sum",),
    "PRODUCT": ("excel_product",),
    "AVERAGE": ("excel_average",),
    "MEAN": ("excel_average",),
    "MEDIAN": ("excel_median",),
    "MIN": ("excel_min",),
    "MAX": ("excel_max",),
    "ROUND": ("excel_round", "decimals"),
    "ROUNDUP": ("excel_roundup", "decimals"),
    "ROUNDDOWN": ("excel_rounddown", "decimals"),
    "INT": ("excel_int",),
    "TRUNC": ("excel_trunc", "decimals"),
    "CEILING": ("excel_ceiling", "significance"),
    "FLOOR": ("excel_floor", "significance"),
    "MOD": ("excel_mod",),
    "POWER": ("excel_power",),
    "SQRT": ("excel_sqrt",),
    "EXP": ("excel_exp",),
    "LN": ("excel_ln",),
    "LOG": ("excel_log", "base"),
    "LOG10": ("excel_log10",),
    "SIGN": ("excel_sign",),
    "RADIANS": ("excel_radians",),
    "DEGREES": ("excel_degrees",),
    "SIN": ("excel_sin",),
    "COS": ("excel_cos",),
    "TAN": ("excel_tan",),
    "ASIN": ("excel_asin",),
    "ACOS": ("excel_acos",),
    "ATAN": ("excel_atan",),
    "ATAN2": ("excel_atan2",),
    "SINH": ("excel_sinh",),
    "COSH": ("excel_cosh",),
    "TANH": ("excel_tanh",),
    "ASINH": ("excel_asinh",),
    "ACOSH": ("excel_acosh",),
    "ATANH": ("excel_atanh",),
    "COT": ("excel_cot",),
    "SEC": ("excel_sec",),
    "CSC": ("excel_csc",),
    "EVEN": ("excel_even",),
    "ODD": ("excel_odd",),
    "STDEV_P": ("excel_stdev_p",),
    "STDEV_S": ("excel_stdev_s",),
    "VAR_P": ("excel_var_p",),
    "VAR_S": ("excel_var_s",),
    "SKEW": ("excel_skew",),
    "KURT": ("excel_kurt",),
    "AND": ("excel_and",),
    "OR": ("excel_or",),
    "NOT": ("excel_not",),
    "LEN": ("excel_len",),
    "UPPER": ("excel_upper",),
    "LOWER": ("excel_lower",),
    "TRIM": ("excel_trim",),
    "TODAY": ("excel_today",),
    "NOW": ("excel_now",),
    "YEAR": ("excel_year",),
    "MONTH": ("excel_month",),
    "DAY": ("excel_day",),
    "HOUR": ("excel_hour",),
    "MINUTE": ("excel_minute",),
    "SECOND": ("excel_second",),
    "WEEKDAY": ("excel_weekday",),
    "WEEKNUM": ("excel_weeknum",),
    "DAYS": ("excel_days",),
}
