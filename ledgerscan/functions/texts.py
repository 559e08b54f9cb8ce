"""Text functions; null counts as empty text. Positions are 1-based."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerscan.functions.coerce import strip, text


def proper(t: Column) -> Column:
    """First letter of every run of letters in upper case, the rest in lower case."""
    runs = F.regexp_extract_all(t, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    cased = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1_000_000_000))))
    return F.array_join(cased, "")


def clean(t: Column) -> Column:
    """Without control characters."""
    return F.regexp_replace(t, r"[\x00-\x1f\x7f]", "")


def find(t: Column, needle: str) -> Column:
    """Position of a literal text, 0 if absent."""
    return F.lit(1) if needle == "" else F.instr(t, needle)


def replace_at(t: Column, start: int, length: int, new: str) -> Column:
    return F.overlay(t, F.lit(new), F.lit(max(int(start), 1)), F.lit(max(int(length), 0)))


def substitute(t: Column, old: str, new: str) -> Column:
    if old == "":
        # an empty search text matches around every character
        return F.concat(F.lit(new), F.regexp_replace(t, r"(?s)(.)", r"$1" + new.replace("\\", r"\\").replace("$", r"\$")))
    return F.replace(t, F.lit(old), F.lit(new))


def left(t: Column, n: int) -> Column:
    """First ``n`` characters; a negative ``n`` leaves out the last ones."""
    return F.substring(t, 1, n) if n >= 0 else F.substring(t, F.lit(1), F.greatest(F.length(t) + n, F.lit(0)))


def right(t: Column, n: int) -> Column:
    """Last ``n`` characters; 0 gives the whole text, a negative ``n`` leaves out the first ones."""
    if n == 0:
        return t
    return F.right(t, F.lit(n)) if n > 0 else F.substring(t, 1 - n, 1_000_000_000)


def mid(t: Column, start: int, n: int) -> Column:
    return F.substring(t, max(int(start), 1), max(int(n), 0))


def concat(values: Sequence[Column | str], sep: str = "") -> Column:
    return F.concat_ws(sep, *[text(v) for v in values])


def join(values: Sequence[Column | str], sep: str = "", ignore_empty: bool = True) -> Column:
    parts = [text(v) for v in values]
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) if ignore_empty else p for p in parts])


def contains_pattern(t: Column, pattern: str) -> Column:
    """Regular expression search, ignoring case."""
    return t.rlike("(?iu)" + pattern)


def trimmed(t: Column) -> Column:
    return strip(t)
