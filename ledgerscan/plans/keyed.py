"""Per-key statistics brought back to the rows they describe.

A window over ``partitionBy(key)`` would put every row of a key into one task. Here the key is
aggregated first (map-side combine makes a hot key one row per map task), and the small result is
joined back in one of two ways, chosen by its counted size:

* few keys, counted and measured in bytes: broadcast, so the wide rows are not shuffled at all;
* many keys: keys that hold at least one ``HOT_KEYS``-th of the rows (so at most ``HOT_KEYS`` keys) are
  broadcast and their rows spread over the reducers by a salt; only lighter keys are co-located by
  the shuffle join, whose partitions adaptive execution can still split.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscan.plans.tables import BROADCAST_BYTES, fits, row_bytes, written

BROADCAST_ROWS = 200_000
HOT_KEYS = 20_000
SALTS = 4_096
HOT_WEIGHT = 100_000


def group_stats(df: DataFrame, keys: dict[str, Column], aggs: dict[str, Column]) -> DataFrame:
    """One row per key; ``__weight`` is the number of rows of the key."""
    needed = df.select("*", *[c.alias(n) for n, c in keys.items()])
    return needed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__weight"), *[c.alias(n) for n, c in aggs.items()]
    )


def order_key(order_by: Sequence[str]) -> Column:
    """The order columns as one comparable value (a lone column stays bare: cheaper to aggregate)."""
    columns = [F.col(f"`{o}`") for o in order_by]
    return columns[0] if len(columns) == 1 else F.struct(*columns)


def _on(left: DataFrame, right: DataFrame, keys: list[str], prefix: str) -> Column:
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[prefix + k]) for k in keys]
    )


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select([F.col(f"`{c}`").alias(prefix + c) for c in df.columns])


def attach(
    df: DataFrame,
    keys: dict[str, Column],
    stats: DataFrame,
    keep: Column | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """``df`` plus the columns of ``stats`` (one row per key, with ``__weight``), matched null-safely.

    With ``keep`` (a condition on ``stats``) only the rows of the kept keys are returned; heavy keys
    that are not kept still take part, so that their rows are dropped before the shuffle.
    """
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    names = list(keys)
    values = [c for c in stats.columns if c not in names]
    rows = df.select("*", *[c.alias(n) for n, c in keys.items()])
    if keep is not None:
        stats = stats.withColumn("__keep", F.coalesce(keep, F.lit(False)))
        stats = stats.filter(F.col("__keep") | (F.col("__weight") >= HOT_WEIGHT))
    else:
        stats = stats.withColumn("__keep", F.lit(True))
    stats = written(stats)
    kept = stats.filter("__keep")
    if fits(kept, limit):
        right = _prefixed(kept, "__s_")
        how = "left" if keep is None else "inner"
        joined = rows.join(F.broadcast(right), _on(rows, right, names, "__s_"), how)
        return joined.select(*df.columns, *[F.col(f"`__s_{v}`").alias(v) for v in values])

    # at most HOT_KEYS keys can each hold 1/HOT_KEYS of the counted rows; long keys or values leave room for fewer
    weights = stats.agg(F.sum("__weight").alias("rows"), F.max(row_bytes(stats)).alias("widest")).first()
    share = max(1, min(HOT_KEYS, BROADCAST_BYTES // (weights["widest"] or 1)))
    hot = _prefixed(stats.filter(F.col("__weight") >= (weights["rows"] or 0) / share), "__h_")
    tagged = rows.join(F.broadcast(hot), _on(rows, hot, names, "__h_"), "left")
    if keep is not None:
        tagged = tagged.filter(F.coalesce(F.col("__h___keep"), F.lit(True)))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(SALTS)) + 1
    salt = F.when(F.col("__h___keep").isNotNull(), spread).otherwise(F.lit(0)).cast("long")
    tagged = tagged.withColumn("__salt", salt)
    cold = _prefixed(kept, "__s_").withColumn("__s_salt", F.lit(0).cast("long"))
    joined = tagged.join(
        cold, _on(tagged, cold, names, "__s_") & (tagged["__salt"] == cold["__s_salt"]), "left"
    )
    if keep is not None:
        joined = joined.filter(F.col("__h___keep").isNotNull() | F.col("__s___keep").isNotNull())
    return joined.select(
        *df.columns,
        *[F.coalesce(F.col(f"`__h_{v}`"), F.col(f"`__s_{v}`")).alias(v) for v in values],
    )
