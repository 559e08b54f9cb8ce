"""Tolerant reading of number, date, truth and text values.

Everything here is a Catalyst expression, no UDF, and messy text columns are parsed in the same pass as
the filter. Parsing goes through array lambdas, which Spark interprets; only plain comparisons are compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits and word sets that decide results.
NUMERIC_ABS_LIMIT = 1e75
EXCEL_EPOCH = "1899-12-30 00:00:00"
EXCEL_MIN_SERIAL, EXCEL_MAX_SERIAL = 1, 2958465
TRUE_WORDS = ["true", "1", "yes", "evet", "dogru", "doğru"]
FALSE_WORDS = ["false", "0", "hayir", "hayır", "no", "yanlış", "yanlis"]
CHECK_FOLD = ("İIıŞşĞğÜüÖöÇç", "iiissgguuoocc")
SCAN_FOLD = ("ıİğĞşŞüÜöÖçÇ", "iiggssuuoocc")

WHITESPACE = " \t\n\r\u000b\f\u00a0"

_TIME = r"([T ]+\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?)?"
_ISO = rf"^\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}{_TIME}(Z|[+-]\d{{2}}:?\d{{2}})?$"
_FOUR_DIGIT_YEAR_LAST = rf"^\d{{1,2}}[-/. ]\d{{1,2}}[-/. ]\d{{4}}{_TIME}$"
_TWO_DIGIT_YEAR_LAST = rf"^\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2}}{_TIME}$"
# Day text and clock: hour, minute, second, half of the day.
_CLOCK = r"^(.*[^T ,])[T ,]+(\d{1,2}):(\d{1,2})(?::(\d{1,2}(?:\.\d{1,9})?))?\s*(?:([AaPp])\.?[Mm]\.?)?$"
_HOUR_ONLY = r"[T ,]+(\d{1,2})\s*([AaPp])\.?[Mm]\.?$"
_SPOKEN = r"(?i)[a-z]{3}|[0-9 ][ap]\.?m\.?$|^\d{8}[T ]?\d|^\d{12,14}$"
_DAY_NAME = r"^(?i:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?i:day)?\.?,?\s+"
_ORDINAL = r"(?<=\d)(?i:st|nd|rd|th)\b"
_DAY_MONTH_YEAR = r"^(\d{1,2})[-/. ]*([A-Za-z]{3,9})[-/., ]*(\d{4}|\d{2})$"
_MONTH_DAY_YEAR = r"^([A-Za-z]{3,9})[-/. ]*(\d{1,2})[-/., ]+(\d{4}|\d{2})$"
_YEAR_MONTH_DAY = r"^(\d{4})[-/., ]*([A-Za-z]{3,9})[-/., ]*(\d{1,2})$"
_MONTH_YEAR = r"^([A-Za-z]{3,9})[-/., ]+(\d{4})$"
_MONTH_NAMES = "january february march april may june july august september october november december".split()


def _col(value: Column | str) -> Column:
    return F.col(f"`{value}`") if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    Filters evaluate a repeated subexpression every time it occurs; a lambda variable does not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.BooleanType))


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def column_type(df: DataFrame, value: Column | str) -> T.DataType:
    """Type of a named or computed column of ``df`` (analysis only, no job)."""
    if isinstance(value, str):
        return df.schema[value].dataType
    return df.select(value).schema[0].dataType


# -- numbers -----------------------------------------------------------------------------


def finite(x: Column) -> Column:
    """NaN, infinities and absurd magnitudes become null."""
    return F.when(F.abs(x) <= F.lit(NUMERIC_ABS_LIMIT), x)


def number_from_text(value: Column | str) -> Column:
    """Number hidden in text: currency signs, brackets for negatives, percent, either decimal mark."""

    def with_signs(packed: Column) -> Column:
        negative = packed.startswith("(") & packed.endswith(")")
        percent = packed.endswith("%") | (negative & packed.endswith("%)"))
        size = let(F.regexp_replace(packed, r"[^0-9,.eE+\-]", ""), with_decimal_mark)
        return F.when(negative, -size).otherwise(size) / F.when(percent, F.lit(100.0)).otherwise(F.lit(1.0))

    def with_decimal_mark(body: Column) -> Column:
        comma_is_last_mark = body.contains(",") & ~F.substring_index(body, ",", -1).contains(".")
        return F.when(comma_is_last_mark, F.translate(body, ",.", ".")).otherwise(F.translate(body, ",", "")).try_cast("double")

    packed = F.translate(strip(text(value)), "\u00a0 ", "")
    return let(let(packed, with_signs), finite)


def number(value: Column | str, dtype: T.DataType) -> Column:
    """Coerced double of a column whose type is known."""
    c = _col(value)
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return c.cast("double")
    if is_numeric(dtype):
        return finite(c.cast("double"))
    return number_from_text(c)


def num(df: DataFrame, value: Column | str) -> Column:
    """Coerced double of a column of ``df``."""
    return number(value, column_type(df, value))


def simple_number(value: Column | str) -> Column:
    """Plain parse after turning commas into dots; anything else is null."""
    t = F.translate(_col(value).cast("string"), ",", ".")
    looks_numeric = t.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(looks_numeric, t.try_cast("double"))


# -- dates -------------------------------------------------------------------------------


def excel_serial(x: Column) -> Column:
    """Timestamp of a spreadsheet day number, null outside the valid range."""
    micros = F.round(x * F.lit(86_400_000_000.0)).cast("long")
    moment = F.timestamp_add("MICROSECOND", micros, F.lit(EXCEL_EPOCH).cast("timestamp_ntz"))
    return F.when(x.between(EXCEL_MIN_SERIAL, EXCEL_MAX_SERIAL), moment)


# The layouts are SQL text: one expression to build, however many rows and filters use it.


def _iso(t: str, pattern: str, *orders: str) -> str:
    """The first order that gives a day: rewritten and cast; the cast returns null instead of raising."""
    return ", ".join(f"try_cast(regexp_replace({t}, r'{pattern}', r'{order}') AS timestamp_ntz)" for order in orders)


def _century(year: str) -> str:
    return f"CASE WHEN try_cast({year} AS int) < 70 THEN '20' ELSE '19' END"


def _numeric_layouts(t: str) -> str:
    """Year-first, day-first, month-first and compact digits, with a clock of 24 hours or none."""
    first = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(\s+|T)?"
    last = r"^(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4})(\s+|T)?"
    short = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})(\s+|T)?"
    tails = [f"regexp_replace({t}, r'{short}', r'$3-${m}-${d} ')" for d, m in ((1, 2), (2, 1))]
    century = _century(f"regexp_extract({t}, r'{short}', 3)")
    shorts = ", ".join(f"try_cast(concat({century}, {x}) AS timestamp_ntz)" for x in tails)
    return f"""CASE WHEN {t} RLIKE r'{_ISO}' THEN coalesce({_iso(t, first, "$1-$2-$3 ", "$1-$3-$2 ")})
      WHEN {t} RLIKE r'{_FOUR_DIGIT_YEAR_LAST}' THEN coalesce({_iso(t, last, "$3-$2-$1 ", "$3-$1-$2 ")})
      WHEN {t} RLIKE r'{_TWO_DIGIT_YEAR_LAST}' THEN coalesce({shorts})
      WHEN {t} RLIKE r'^\\d{{8}}$' THEN {_iso(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")} END"""


def _named_day(t: str) -> str:
    """Midnight of a day whose month is a name: day, month and year in the three usual orders, or a month's first day."""
    numbers = {word: i for i, name in enumerate(_MONTH_NAMES, 1) for word in (name, name[:3])} | {"sept": 9}
    listed = ",".join(f"{word}:{i}" for word, i in numbers.items())

    def read(pattern: str, year: int, month: int, day: int | None = None) -> str:
        y, m = (f"regexp_extract({t}, r'{pattern}', {group})" for group in (year, month))
        d = f"regexp_extract({t}, r'{pattern}', {day})" if day else "'1'"
        full = f"CASE WHEN length({y}) = 2 THEN concat({_century(y)}, {y}) ELSE {y} END"
        number = f"try_element_at(str_to_map('{listed}', ',', ':'), lower({m}))"
        return f"WHEN {t} RLIKE r'{pattern}' THEN try_cast(concat({full}, '-', {number}, '-', {d}) AS timestamp_ntz)"

    orders = [read(_DAY_MONTH_YEAR, 3, 2, 1), read(_MONTH_DAY_YEAR, 3, 1, 2), read(_YEAR_MONTH_DAY, 1, 2, 3), read(_MONTH_YEAR, 2, 1)]
    return f"CASE {' '.join(orders)} END"


def _spoken_moment(t: str) -> str:
    """Tokens of a date in words: a day name, a day in numbers or with a named month, a clock of 12 or 24 hours.

    The clock is cut off first, so every day layout takes every clock.
    """

    def part(group: int) -> str:
        return f"regexp_extract(s, r'{_CLOCK}', {group})"

    text = t
    for pattern, order in (
        (_DAY_NAME, ""),
        (_ORDINAL, ""),
        (_HOUR_ONLY, " $1:00 $2m"),
        (r"^(\d{8})[T ]?(\d{2})(\d{2})(\d{2})$", "$1 $2:$3:$4"),
        (r"^(\d{8})[T ]?(\d{2})(\d{2})$", "$1 $2:$3"),
    ):
        text = f"regexp_replace({text}, r'{pattern}', r'{order}')"
    clock = f"""CASE WHEN s RLIKE r'{_CLOCK}' THEN named_struct('d', {part(1)}, 'h', try_cast({part(2)} AS int), 'm', try_cast({part(3)} AS int),
      's', CASE WHEN {part(4)} = '' THEN 0D ELSE try_cast({part(4)} AS double) END, 'half', lower({part(5)}))
      ELSE named_struct('d', s, 'h', 0, 'm', 0, 's', 0D, 'half', '') END"""
    valid = "m <= 59 AND s < 60 AND h BETWEEN IF(half = '', 0, 1) AND IF(half = '', 23, 12)"
    hour = "IF(half = '', h, h % 12 + IF(half = 'p', 12, 0))"
    for name in ("half", "h", "m", "s"):
        valid, hour = (re.sub(rf"\b{name}\b", f"p.{name}", x) for x in (valid, hour))
    micros = f"CAST(({hour} * 60 + p.m) * 60 AS bigint) * 1000000 + CAST(floor(round(p.s * 1000000D, 3)) AS bigint)"
    moment = f"CASE WHEN {valid} THEN timestampadd(MICROSECOND, {micros}, coalesce({_numeric_layouts('p.d')}, {_named_day('p.d')})) END"
    return f"element_at(transform(transform(array({text}), s -> {clock}), p -> {moment}), 1)"


_READ_MOMENT = f"""t -> coalesce({_numeric_layouts("t")},
  CASE WHEN t RLIKE r'^\\d{{4}}(-\\d{{1,2}})?$' THEN try_cast(t AS timestamp_ntz) WHEN t RLIKE r'{_SPOKEN}' THEN {_spoken_moment("t")} END)"""


def timestamp_from_text(value: Column | str) -> Column:
    """Date text: year-first, then day-first, then month-first, then a spreadsheet day number.

    Text with a month or day name, a 12-hour clock or compact digits with a clock is read token by token;
    the check for such text keeps that reading away from all other rows. A two-digit year below 70 is in the 2000s.
    """
    t = F.trim(_col(value).cast("string"), F.lit(WHITESPACE))
    read = F.element_at(F.call_function("transform", F.array(t), F.expr(_READ_MOMENT)), 1)
    serial = F.when(t.rlike(r"^\d{1,7}(\.\d*)?$"), excel_serial(t.try_cast("double")))
    return F.coalesce(read, serial)


def moment(value: Column | str, dtype: T.DataType) -> Column:
    """Coerced timestamp (without zone) of a column whose type is known."""
    c = _col(value)
    if isinstance(dtype, T.TimestampNTZType):
        return c
    if is_datetime(dtype):
        return c.cast("timestamp_ntz")
    if is_numeric(dtype):
        return excel_serial(finite(c.cast("double")))
    return timestamp_from_text(c)


def when_(df: DataFrame, value: Column | str) -> Column:
    """Coerced timestamp of a column of ``df``."""
    return moment(value, column_type(df, value))


def day(ts: Column) -> Column:
    """Calendar day of a timestamp."""
    return ts.cast("date")


def date_literal(value) -> Column:
    """One date parameter, read with the same rules as a date column."""
    if isinstance(value, Column):
        return value
    return timestamp_from_text(F.lit(None if value is None else str(value)))


# -- text --------------------------------------------------------------------------------


def text(value: Column | str) -> Column:
    """Text of any column; null counts as empty."""
    return F.coalesce(_col(value).cast("string"), F.lit(""))


def strip(value: Column) -> Column:
    return F.trim(value, F.lit(WHITESPACE))


def normalized(value: Column | str, trim: bool = True, case_sensitive: bool = False, fold: bool = False) -> Column:
    """Text prepared for comparison: trimmed, optionally folded to plain letters, lower-cased."""
    t = text(value)
    if trim:
        t = strip(t)
    if fold:
        t = F.translate(t, *CHECK_FOLD)
    return t if case_sensitive else F.lower(t)


def folded(value: Column | str) -> Column:
    """Text prepared for keyword scans."""
    return F.lower(F.translate(text(value), *SCAN_FOLD))


def fold_word(word: str) -> str:
    """The same preparation for a keyword given as a parameter."""
    return word.translate(str.maketrans(*SCAN_FOLD)).lower()


def truthy(value: Column | str, dtype: T.DataType | None = None) -> Column:
    """Boolean reading of a value; null is false."""
    if isinstance(dtype, T.BooleanType):
        return F.coalesce(_col(value), F.lit(False))
    return F.lower(strip(text(value))).isin(TRUE_WORDS)


# -- parameters --------------------------------------------------------------------------


def value_list(
    value, trim: bool = True, drop_empty: bool = True, dedupe: bool = True, ignore_case: bool = True
) -> list[str]:
    """A list parameter, given as a list or as text split on newline, comma, semicolon or tab."""
    if isinstance(value, Iterable) and not isinstance(value, str):
        items = [str(v) for v in value]
    else:
        items = re.split(r"[\n\r,;\t]+", str(value or ""))
    if trim:
        items = [v.strip() for v in items]
    if drop_empty:
        items = [v for v in items if v]
    if dedupe:
        first_of = {}
        for v in items:
            first_of.setdefault(v.lower() if ignore_case else v, v)
        items = list(first_of.values())
    return items


def float_param(value, default: float | None = None) -> float | None:
    """A numeric parameter; text goes through the tolerant rules of :func:`number_from_text`."""
    if value is None or value == "":
        return default
    if isinstance(value, (int, float)):
        return float(value)
    return _number_of_text(str(value), default)


def _number_of_text(raw: str, default: float | None) -> float | None:
    packed = raw.strip().replace("\u00a0", "").replace(" ", "")
    negative = packed.startswith("(") and packed.endswith(")")
    percent = packed.rstrip(")").endswith("%") if negative else packed.endswith("%")
    body = re.sub(r"[^0-9,.eE+\-]", "", packed)
    if body.rfind(",") > body.rfind("."):
        body = body.replace(".", "").replace(",", ".")
    else:
        body = body.replace(",", "")
    try:
        parsed = float(body)
    except ValueError:
        return default
    parsed = -parsed if negative else parsed
    return parsed / 100 if percent else parsed


def any_of(words: Iterable[str]) -> str:
    """Java regex that matches any of the words literally."""
    return "|".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in words)
