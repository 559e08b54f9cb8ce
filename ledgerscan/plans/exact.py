"""Sums of numbers that do not depend on the order of addition, at any size.

A double is taken as the decimal number it is written as: an integer of up to 17 digits and a power of ten.
The integer is moved to the next lower multiple of nine in the exponent, its window (26 digits at most),
and integers of one window add up without loss - in every task first, so that a hot key is a few rows
a task. The windows of a key, at most some fifty, are carried into one number and rounded once.
Usual amounts (nine decimals at most, below 1e15) are all of one window and are added as they are, as one
decimal column; only the others are taken apart, in a branch that is empty where there are none.

So 1e32 and 1e-9 of one key both count, opposite amounts cancel to nothing, and totals are the same for
any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 9
#: Amounts below it with no more than nine decimals are one integer of the window of nanos.
USUAL = 1e15
_WHOLE = "decimal(38,0)"


def usual(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with ``__u0, __u1, ...``: the amounts as decimals, null if they are not usual.

    One projection reads an amount, the next compares: in one expression it would be read twice.
    """
    read = [F.when(F.abs(F.col(n)) < USUAL, F.col(n).try_cast("decimal(24,9)")).alias(f"__u{k}") for k, n in enumerate(names)]
    same = [F.when(F.col(f"__u{k}").cast("double") == F.col(n), F.col(f"__u{k}")).alias(f"__u{k}") for k, n in enumerate(names)]
    return df.select("*", *read).select(*df.columns, *same)


def window_of(text: Column) -> Column:
    """``struct(w, m)`` with ``x = m * 10 ** (9 * w)`` from the text of a double ``x``."""
    mantissa = F.substring_index(text, "E", 1)
    power = F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
    power = power - (F.length(mantissa) - F.instr(mantissa, "."))
    window = F.floor(power / DIGITS).cast("int")
    shift = F.element_at(F.array(*[F.lit(10**k).cast("decimal(9,0)") for k in range(DIGITS)]), (power - window * DIGITS + 1).cast("int"))
    digits = (F.replace(mantissa, F.lit("."), F.lit("")).cast("decimal(20,0)") * shift).cast(_WHOLE)
    return F.struct(window.alias("w"), digits.alias("m"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _carried(dense: Column) -> Column:
    """``struct(carry, digits)`` of windows without gaps, lowest first."""
    base = F.lit(10**DIGITS).cast("decimal(10,0)")

    def step(seen: Column, m: Column) -> Column:
        def cut(total: Column) -> Column:
            def of(low: Column) -> Column:
                carry = ((total - low).cast(_WHOLE) * F.lit("0.000000001").cast("decimal(10,9)")).cast(_WHOLE)
                return F.struct(carry.alias("carry"), F.concat(F.lpad(low.cast("string"), DIGITS, "0"), seen.getField("digits")).alias("digits"))

            return _once(F.pmod(total, base).cast(_WHOLE), of)

        return _once((m + seen.getField("carry")).cast(_WHOLE), cut)

    return F.aggregate(dense, F.struct(F.lit(0).cast(_WHOLE).alias("carry"), F.lit("").alias("digits")), step)


def total_of(windows: Column) -> Column:
    """The sum of ``array<struct(w, m)>`` as the nearest double; 0 for an empty array."""

    def number(sign: str, digits: Column, lowest: Column) -> Column:
        return F.concat(F.lit(sign), digits, F.lit("E"), (lowest * DIGITS).cast("string")).cast("double")

    def dense(all_: Column, lowest: Column) -> Column:
        def at(w: Column) -> Column:
            same = F.filter(all_, lambda e: e.getField("w") == w)
            return F.aggregate(same, F.lit(0).cast(_WHOLE), lambda s, e: (s + e.getField("m")).cast(_WHOLE))

        return F.transform(F.sequence(lowest, F.array_max(all_.getField("w"))), at)

    def text(carried: Column) -> Column:
        return F.concat(carried.getField("carry").cast("string"), carried.getField("digits"))

    def signed(parts: Column, lowest: Column) -> Column:
        def of(carried: Column) -> Column:
            minus = F.transform(parts, lambda m: (-m).cast(_WHOLE))
            opposite = _once(_carried(minus), lambda c: number("-", text(c), lowest))
            return F.when(carried.getField("carry") < 0, opposite).otherwise(number("", text(carried), lowest))

        one = number("", F.element_at(parts, 1).cast("string"), lowest)
        return F.when(F.size(parts) == 1, one).otherwise(_once(_carried(parts), of))

    def added(all_: Column) -> Column:
        spread = _once(F.array_min(all_.getField("w")), lambda low: _once(dense(all_, low), lambda parts: signed(parts, low)))
        return F.when(F.size(all_) == 0, F.lit(0.0)).otherwise(spread)

    return _once(F.filter(windows, lambda e: F.coalesce(e.getField("m") != 0, F.lit(True))), added)


def group_sums(df: DataFrame, keys: dict[str, Column], values: dict[str, Column], totals: dict[str, dict[str, int]]) -> DataFrame:
    """One row per key: ``__weight`` rows and the ``totals``, each a sum of ``values`` with signs 1 or -1."""
    names = list(values)
    rows = df.select(*[c.alias(n) for n, c in keys.items()], *[values[n].cast("double").alias(f"__x{k}") for k, n in enumerate(names)])
    rows = usual(rows, [f"__x{k}" for k in range(len(names))])
    plain = [F.sum(F.col(f"__u{k}").cast("decimal(37,9)")).cast("decimal(37,9)").alias(f"__u{k}") for k in range(len(names))]
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__weight"), *plain)

    # texts, windows and entries in a projection each, as in usual(); the array of ready entries is generated code
    texts = [F.when(F.col(f"__u{k}").isNull(), F.col(f"__x{k}").cast("string")).alias(f"__t{k}") for k in range(len(names))]
    windows = [window_of(F.col(f"__t{k}")).alias(f"__e{k}") for k in range(len(names))]
    entries = [F.struct(F.lit(k).alias("v"), F.col(f"__e{k}").alias("at")) for k in range(len(names))]
    apart = rows.select(*keys, *texts).select(*keys, *windows).select(*keys, F.explode(F.array(*entries)).alias("e"))
    apart = apart.select(*keys, "e.v", "e.at.*").filter("w is not null")
    added = apart.groupBy(*keys, "v", "w").agg(F.sum("m").cast(_WHOLE).alias("m"))
    lists = [F.collect_list(F.when(F.col("v") == k, F.struct("w", "m"))).alias(f"__w{k}") for k in range(len(names))]
    rest = added.groupBy(*[F.col(f"`{n}`").alias(f"__k{i}") for i, n in enumerate(keys)]).agg(*lists)
    same = reduce(lambda a, b: a & b, [stats[n].eqNullSafe(rest[f"__k{i}"]) for i, n in enumerate(keys)])
    both = stats.join(rest, same, "left")

    def of(parts: dict[str, int]) -> Column:
        whole, windows = F.lit(0).cast("decimal(37,9)"), []
        for name, sign in parts.items():
            k = names.index(name)
            u, own = F.coalesce(F.col(f"__u{k}"), F.lit(0).cast("decimal(37,9)")), F.col(f"__w{k}")
            whole = (whole + u if sign > 0 else whole - u).cast("decimal(37,9)")
            windows.append(own if sign > 0 else F.transform(own, lambda e: F.struct(e.getField("w").alias("w"), (-e.getField("m")).cast(_WHOLE).alias("m"))))
        # the usual part as billions and billionths, which are windows too
        high = F.floor(whole).cast(_WHOLE)
        low = ((whole - high.cast("decimal(37,9)")).cast("decimal(18,9)") * F.lit(10**DIGITS).cast("decimal(10,0)")).cast(_WHOLE)
        pair = F.array(F.struct(F.lit(0).alias("w"), high.alias("m")), F.struct(F.lit(-1).alias("w"), low.alias("m")))
        return F.when(F.col("__w0").isNull(), whole.cast("double")).otherwise(total_of(F.concat(pair, *windows)))

    # generated, not projected: a filter on a total would be moved below a projection and add everything up again
    sums = F.struct(*[of(parts).alias(n) for n, parts in totals.items()])
    return both.select(*keys, "__weight", F.inline(F.array(sums)))
