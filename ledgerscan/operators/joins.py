"""Joins. Missing keys match each other, and clashing right-hand names get a suffix."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscan.plans.keyed import BROADCAST_ROWS, HOT_WEIGHT
from ledgerscan.plans.tables import fits, written

#: A key is hot with this share of its side; the sketch keeps enough items to miss none of these.
HOT_SHARE = 2_000
SKETCH_TOP, SKETCH_ITEMS = 5_000, 10_000
#: Most parts in which one side's rows of a key are cut; each row of the other side is repeated as often.
GRID_SIDE = 64
HOW = {"left": "left", "right": "right", "inner": "inner", "outer": "full"}


def _names(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)


def _match(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)])


def join(
    left: DataFrame,
    right: DataFrame,
    left_on: str | Sequence[str],
    right_on: str | Sequence[str],
    how: str = "left",
    suffix: str = "_r",
    skewed: bool | None = None,
    hot_rows: int = HOT_WEIGHT,
) -> DataFrame:
    """Equi-join on one or more keys. Keys of the same name become one column.

    Catalyst broadcasts a side it measures as small; otherwise adaptive execution splits skewed
    partitions of an inner sort-merge join. It cannot do that for an outer join on both sides. Outer joins
    therefore look for hot keys first (a job over the key columns of both sides): with a key of at least
    ``hot_rows`` rows and a 2,000th of its side, the rows of such keys are joined on a grid (see
    :func:`_hot_join`) and only the others by the plain join. ``skewed=False`` skips the search; ``skewed=True``
    skips it too and plans the whole join as inner join plus the rows without a partner.
    """
    if how not in HOW:
        raise ValueError("Invalid join type")
    lk, rk = _names(left_on), _names(right_on)
    if not lk or len(lk) != len(rk):
        raise ValueError("Join requires left and right key columns")
    if skewed and how != "inner":
        return _with_unmatched(join(left, right, lk, rk, "inner", suffix), left, right, lk, rk, how, suffix)
    if skewed is None and how != "inner":
        hot = hot_keys(left, right, lk, rk, hot_rows)
        if hot is not None:
            return _hot_join(left, right, lk, rk, how, suffix, hot)
    return _plain(left, right, lk, rk, how, suffix)


def _with_unmatched(inner: DataFrame, left, right, lk, rk, how: str, suffix: str) -> DataFrame:
    """The inner join and the rows that an outer join adds to it."""
    parts = [inner]
    if how in ("left", "outer"):
        parts.append(_plain(anti(left, right, lk, rk), right.limit(0), lk, rk, "left", suffix))
    if how in ("right", "outer"):
        parts.append(_plain(left.limit(0), anti(right, left, rk, lk), lk, rk, "right", suffix))
    return reduce(DataFrame.unionByName, parts)


def _digest(columns: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def hot_keys(left: DataFrame, right: DataFrame, lk: Sequence[str], rk: Sequence[str], hot_rows: int = HOT_WEIGHT) -> DataFrame | None:
    """``__hot, __down, __across`` of the digests of hot keys: the parts in which rows of each side are cut; None without any.

    Found by a frequent-items sketch of each side: merged from map tasks, no shuffle by key, and its error
    (a 4,600th of the rows) is below the share asked for, so no hot key is missed. At most a few thousand digests.
    Keys of different types on the two sides have no common digest and are not looked for.
    """
    if [left.schema[k].dataType for k in lk] != [right.schema[k].dataType for k in rk]:
        return None
    found: dict[int, list[int]] = {}
    for side, (df, on) in enumerate(((left, lk), (right, rk))):
        sketch = F.expr(f"approx_top_k(__hot, {SKETCH_TOP}, {SKETCH_ITEMS})")
        seen = df.select(_digest(on).alias("__hot")).agg(F.count(F.lit(1)).alias("rows"), sketch.alias("top")).first()
        bound = max(hot_rows, seen["rows"] / HOT_SHARE)
        for item in seen["top"] or []:
            if item["count"] >= bound:
                found.setdefault(item["item"], [1, 1])[side] = min(GRID_SIDE, -(-item["count"] // hot_rows))
    if not found:
        return None
    rows = [(digest, *parts) for digest, parts in found.items()]
    return left.sparkSession.createDataFrame(rows, "__hot long, __down long, __across long")


def _hot_join(left, right, lk, rk, how: str, suffix: str, hot: DataFrame) -> DataFrame:
    """An outer join whose hot keys are joined cell by cell.

    The rows of a hot key are dealt to ``__down`` parts on the left and ``__across`` parts on the right by a digest
    of the whole row; a part meets every part of the other side in a cell of its own, so no task holds a key.
    Equal keys have equal digests: a key is hot on both sides or on neither, and no pair is lost or met twice.
    """

    def split(df: DataFrame, on: Sequence[str], mine: str, other: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        tagged = df.withColumn("__digest", _digest(on)).join(F.broadcast(hot), F.col("__digest") == F.col("__hot"), "left")
        light = tagged.filter("__hot IS NULL").select(*[F.col(f"`{c}`") for c in df.columns])
        heavy = tagged.filter("__hot IS NOT NULL")
        part = F.pmod(F.xxhash64(F.lit(7), *[F.col(f"`{c}`") for c in df.columns]), F.col(mine))
        cells = heavy.withColumn("__mine", part).withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        names = {"__down": ("__mine", "__other"), "__across": ("__other", "__mine")}[mine]
        plain = [F.col(f"`{c}`") for c in df.columns]
        return light, heavy.select(*plain), cells.select(*plain, F.col(names[0]).alias("__row"), F.col(names[1]).alias("__column"))

    light_left, heavy_left, cells_left = split(left, lk, "__down", "__across")
    light_right, heavy_right, cells_right = split(right, rk, "__across", "__down")
    grid = ["__row", "__column"]
    heavy = _plain(cells_left, cells_right, [*lk, *grid], [*rk, *grid], "inner", suffix).drop(*grid)
    heavy = _with_unmatched(heavy, heavy_left, heavy_right, lk, rk, how, suffix)
    return _plain(light_left, light_right, lk, rk, how, suffix).unionByName(heavy)


def _plain(left: DataFrame, right: DataFrame, lk: Sequence[str], rk: Sequence[str], how: str, suffix: str) -> DataFrame:
    """The join as Catalyst plans it."""
    inner = right.select([F.col(f"`{n}`").alias(f"__r_{n}") for n in right.columns])
    shared = {a for a, b in zip(lk, rk, strict=True) if a == b}
    joined = left.join(inner, _match([left[f"`{k}`"] for k in lk], [inner[f"`__r_{k}`"] for k in rk]), HOW[how])
    out = []
    for n in left.columns:
        mine, theirs = F.col(f"`{n}`"), F.col(f"`__r_{n}`")
        out.append(F.coalesce(mine, theirs).alias(n) if n in shared and how in ("right", "outer") else mine)
    for n in right.columns:
        if n not in shared:
            out.append(F.col(f"`__r_{n}`").alias(n + suffix if n in left.columns else n))
    return joined.select(*out)


def semi(left: DataFrame, right: DataFrame, left_on, right_on) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``."""
    return _exists(left, right, left_on, right_on, "left_semi")


def anti(left: DataFrame, right: DataFrame, left_on, right_on) -> DataFrame:
    """Rows of ``left`` whose key does not occur in ``right``."""
    return _exists(left, right, left_on, right_on, "left_anti")


def _exists(left: DataFrame, right: DataFrame, left_on, right_on, how: str) -> DataFrame:
    """Key test against the distinct right keys.

    The keys are written first: their count and bytes decide between a broadcast (the left side is not
    shuffled) and a shuffle join of two plain scans, whose skewed left partitions adaptive execution
    can split. A key repeated a billion times on the right is one row per map task.
    """
    keys = right.select([F.col(f"`{k}`").alias(f"__r_{i}") for i, k in enumerate(_names(right_on))]).distinct()
    keys = written(keys)
    on = _match([left[f"`{k}`"] for k in _names(left_on)], [keys[n] for n in keys.columns])
    return left.join(F.broadcast(keys) if fits(keys, BROADCAST_ROWS) else keys, on, how)
