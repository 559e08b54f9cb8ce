"""Order-dependent work without a single-task window.

Rows are range-partitioned on the full order and written once, so the bucket of a row is stable.
Every bucket is then processed by ordinary windows partitioned by the bucket; what crosses a bucket
edge (counts, sums, last values) is a table of at most a few rows per bucket, prefix-combined and
broadcast. A partition column that holds a third of all rows is spread over many buckets like any
other range. The order must be unique per row.

The written rows are bucketed by their range, so windows over a bucket read them without another
exchange: the wide rows cross the network once. A row that lies ``k`` places before another, in a
different bucket, is found through the ranges of places: every row sends at most one narrow copy,
however large ``k`` is.
"""

from __future__ import annotations

import copy
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscan.plans import keyed, tables

SMALL_GROUP_ROWS = 1_000_000
#: Sketches of large groups: a rank is found to a ``SKETCH``-th of the rows; the bounds taken lie four times as far away.
SKETCH, SLACK = 10_000, 4
# Number of buckets; None takes one a range of bounded size, and leaves small tables to adaptive execution.
BUCKETS: int | None = None


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(f"`{n}`") if isinstance(n, str) else n for n in names]


class OrderedRows:
    """Rows of ``df`` in buckets of ascending ``(partition_by, order_by)``.

    Every row knows its bucket and its 0-based place in it (``__bucket``, ``__at``), both taken from
    the sorted range partitions while they are written.
    """

    def __init__(
        self,
        df: DataFrame,
        order_by: Sequence[str | Column],
        partition_by: Sequence[str] = (),
        buckets: int | None = None,
    ):
        if not order_by:
            raise ValueError("an order-dependent operator needs order_by columns")
        self.partition_by = list(partition_by)
        self.parts = buckets or BUCKETS or tables.parts_for(df)
        layout = [*_columns(self.partition_by), *_columns(order_by)]
        # adaptive execution merges ranges of small tables
        small = not buckets and not BUCKETS and self.parts <= df.sparkSession.sparkContext.defaultParallelism
        ranged = df.repartitionByRange(*layout) if small else df.repartitionByRange(self.parts, *layout)
        placed = ranged.sortWithinPartitions(*layout)
        # the id holds the partition in its upper bits and the place inside it in the lower 33
        placed = placed.withColumn("__id", F.monotonically_increasing_id())
        part = F.shiftright("__id", 33).cast("int")
        # ranges have ascending numbers that are hashed to buckets of their own, so that a task gets one range
        numbers = tables.apart(df.sparkSession, self.parts)
        number = F.coalesce(F.get(F.lit(numbers), part), part + (numbers[-1] + 1))
        placed = placed.select(*_columns(df.columns), number.alias("__bucket"), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
        self.rows = tables.written_in_buckets(placed, "__bucket", self.parts)

    def divided(self, rows: DataFrame, *names: str) -> OrderedRows:
        """The same layout with ``rows`` (its rows and more columns), whose groups are divided further by ``names``."""
        inner = copy.copy(self)
        inner.rows = rows
        inner.partition_by = [*self.partition_by, *names]
        return inner

    # -- pieces ---------------------------------------------------------------------------

    def group(self) -> Column:
        return F.struct(F.lit(0).alias("__g"), *_columns(self.partition_by))

    def window(self):
        """Rows of one group inside one bucket, in order."""
        return Window.partitionBy("__bucket", *_columns(self.partition_by)).orderBy("__at")

    def _starts(self) -> DataFrame:
        """One row per bucket: the number of rows in all earlier buckets."""
        sizes = self.rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
        before = F.sum("__n").over(
            Window.partitionBy(F.lit(0)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        )
        return sizes.select(F.col("__bucket").alias("__start_bucket"), F.coalesce(before, F.lit(0)).alias("__start"))

    def _edges(self, rows: DataFrame, aggs: dict[str, Column]) -> DataFrame:
        """Aggregates of the first and last group of every bucket: at most two rows per bucket."""
        if not self.partition_by:
            return rows.groupBy("__bucket", self.group().alias("__group")).agg(*[c.alias(n) for n, c in aggs.items()])
        sizes = self.rows.groupBy(F.col("__bucket").alias("__edge_bucket")).agg(F.count(F.lit(1)).alias("__n"))
        ends = self.rows.join(F.broadcast(sizes), F.col("__bucket") == F.col("__edge_bucket"))
        ends = ends.filter((F.col("__at") == 0) | (F.col("__at") == F.col("__n") - 1))
        ends = ends.select("__edge_bucket", self.group().alias("__end")).distinct()
        at_edge = rows.join(
            F.broadcast(ends),
            (F.col("__bucket") == F.col("__edge_bucket")) & self.group().eqNullSafe(F.col("__end")),
            "left_semi",
        )
        return at_edge.groupBy("__bucket", self.group().alias("__group")).agg(
            *[c.alias(n) for n, c in aggs.items()]
        )

    def _with_edges(self, rows: DataFrame, edges: DataFrame) -> DataFrame:
        edges = edges.withColumnRenamed("__bucket", "__edge_bucket")
        on = (F.col("__bucket") == F.col("__edge_bucket")) & self.group().eqNullSafe(F.col("__group"))
        return rows.join(F.broadcast(edges), on, "left").drop("__edge_bucket", "__group")

    @staticmethod
    def _earlier():
        return Window.partitionBy("__group").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)

    # -- operators ------------------------------------------------------------------------

    def with_place(self, name: str = "__place") -> DataFrame:
        """1-based place of every row in the whole order; no shuffle."""
        starts = self._starts()
        placed = self.rows.join(F.broadcast(starts), F.col("__bucket") == F.col("__start_bucket"))
        return placed.withColumn(name, F.col("__start") + F.col("__at") + 1).drop("__start_bucket", "__start")

    def with_position(self, name: str = "__position") -> DataFrame:
        """1-based position of every row inside its partition group."""
        if not self.partition_by:
            return self.with_place(name)
        edges = self._edges(self.rows, {"__n": F.count(F.lit(1))})
        edges = edges.select(
            "__bucket", "__group", F.coalesce(F.sum("__n").over(self._earlier()), F.lit(0)).alias("__before")
        )
        placed = self._with_edges(self.rows, edges)
        local = F.row_number().over(self.window())
        return placed.withColumn(name, local + F.coalesce("__before", F.lit(0))).drop("__before")

    def with_running_sum(self, value: Column, name: str, total: str | None = None) -> DataFrame:
        """Running sum of ``value`` (null counts as nothing); optionally the group total too."""
        return self.with_running_sums({name: value}, {name: total} if total else {})

    def with_running_sums(
        self, values: dict[str, Column], totals: dict[str, str] | None = None, after: dict[str, str] | None = None
    ) -> DataFrame:
        """A running sum a value, with further names for the total of the group and for the sum from its row to the end."""
        totals, after = totals or {}, after or {}
        inner = {n: f"__v{i}" for i, n in enumerate(values)}
        rows = self.rows.withColumns({inner[n]: v for n, v in values.items()})
        edges = self._edges(rows, {v: F.sum(v) for v in inner.values()})
        whole = Window.partitionBy("__group")
        later = whole.orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
        edges = edges.select(
            "__bucket",
            "__group",
            *[F.sum(v).over(self._earlier()).alias(f"{v}_before") for v in inner.values()],
            *[F.sum(inner[n]).over(later).alias(f"{inner[n]}_behind") for n in after],
            *[F.sum(inner[n]).over(whole).alias(f"{inner[n]}_whole") for n in totals],
        )
        out = self._with_edges(rows, edges)
        groups = Window.partitionBy("__bucket", *_columns(self.partition_by))
        onward = groups.orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
        backward = groups.orderBy(F.desc("__at")).rowsBetween(Window.unboundedPreceding, 0)
        for name, v in inner.items():
            zero = F.lit(0).cast(rows.schema[v].dataType)
            out = out.withColumn(name, F.coalesce(F.sum(v).over(onward), zero) + F.coalesce(f"{v}_before", zero))
            if name in after:
                rest = F.coalesce(F.sum(v).over(backward), zero) + F.coalesce(f"{v}_behind", zero)
                out = out.withColumn(after[name], rest)
            if name in totals:
                out = out.withColumn(totals[name], F.coalesce(f"{v}_whole", F.sum(v).over(groups)))
        return out.drop(*[f"{v}{part}" for v in inner.values() for part in ("", "_before", "_behind", "_whole")])

    def with_last_known(self, value: Column, name: str) -> DataFrame:
        """``value`` carried forward over nulls."""
        rows = self.rows.withColumn("__v", value)
        known = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__at")))
        edges = self._edges(rows, {"__last": known})
        edges = edges.select(
            "__bucket", "__group", F.last("__last", ignorenulls=True).over(self._earlier()).alias("__before")
        )
        placed = self._with_edges(rows, edges)
        local = F.last("__v", ignorenulls=True).over(self.window().rowsBetween(Window.unboundedPreceding, 0))
        return placed.withColumn(name, F.coalesce(local, F.col("__before"))).drop("__v", "__before")

    def _reached(self, first: int, last: int) -> DataFrame:
        """Pairs of buckets: places ``first`` to ``last`` behind some row of ``__from`` lie in another one, ``__to``.

        Two rows a bucket for one shift; the ranges meet by sorting their bounds, not in pairs.
        """
        sizes = self.rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))
        upto = Window.partitionBy(F.lit(0)).orderBy("__bucket")
        ranges = sizes.select(
            "__bucket",
            F.row_number().over(upto).alias("__index"),
            F.coalesce(F.sum("__n").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"),
            (F.sum("__n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("__end"),
        )
        bounds = F.array(
            F.struct(F.col("__start").alias("__place"), F.lit(0).alias("__kind")),
            F.struct((F.col("__start") + first).alias("__place"), F.lit(1).alias("__kind")),
            F.struct((F.col("__end") + last).alias("__place"), F.lit(2).alias("__kind")),
        )
        events = ranges.select("__index", F.explode(bounds).alias("__b")).select("__index", "__b.*")
        sweep = Window.partitionBy(F.lit(0)).orderBy("__place", "__kind").rowsBetween(Window.unboundedPreceding, 0)
        holder = F.last(F.when(F.col("__kind") == 0, F.col("__index")), ignorenulls=True).over(sweep)
        events = events.withColumn("__holder", holder).groupBy("__index").agg(
            F.max(F.when(F.col("__kind") == 1, F.col("__holder"))).alias("__low"),
            F.max(F.when(F.col("__kind") == 2, F.col("__holder"))).alias("__high"),
        )
        pairs = events.select("__index", F.explode(F.sequence("__low", "__high")).alias("__other"))
        source = ranges.select("__index", F.col("__bucket").alias("__from"), F.col("__start").alias("__from_start"))
        target = ranges.select(
            F.col("__index").alias("__other"),
            F.col("__bucket").alias("__to"),
            F.col("__start").alias("__to_start"),
            F.col("__end").alias("__to_end"),
        )
        pairs = pairs.filter("__index <> __other").join(F.broadcast(source), "__index").join(F.broadcast(target), "__other")
        return pairs.drop("__index", "__other")

    def _copies(self, rows: DataFrame, names: Sequence[str], first: int, last: int, wanted: Column, at: Column) -> DataFrame:
        """Copies of ``names`` and the partition columns in the buckets that want them, dealt as the rows are."""
        place = (F.col("__from_start") + F.col("__at")).alias("__p")
        pairs = F.broadcast(self._reached(first, last))
        plain = dict.fromkeys([*self.partition_by, *names])
        sent = rows.select(*_columns(list(plain)), "__bucket", "__at").join(pairs, F.col("__bucket") == F.col("__from"))
        sent = sent.select(*_columns(list(plain)), "__to", "__to_start", "__to_end", place).filter(wanted)
        sent = sent.select(*_columns(list(plain)), F.col("__to").alias("__bucket"), at.alias("__at"))
        return sent.repartition(self.parts, "__bucket").withColumn("__halo", F.lit(True))

    def with_halo(self, rows: DataFrame, depth: int, names: Sequence[str] | None = None) -> DataFrame:
        """``rows`` plus, per bucket, copies of the ``depth`` rows before it in the whole order.

        Copies hold ``names`` (all columns, if not given) and the partition columns, ``__halo = true``
        and a negative ``__at``, so they sort before the bucket's own rows. A bucket gets at most
        ``depth`` copies, also when they come from several buckets.
        """
        names = [n for n in rows.columns if n not in ("__bucket", "__at")] if names is None else names
        near = (F.col("__p") >= F.col("__to_start") - depth) & (F.col("__p") < F.col("__to_start"))
        copies = self._copies(rows, names, 0, depth, near, F.col("__p") - F.col("__to_start"))
        return rows.withColumn("__halo", F.lit(False)).unionByName(copies, allowMissingColumns=True)

    def with_lag(self, rows: DataFrame, value: str, name: str, k: int) -> DataFrame:
        """Column ``value`` of the row ``k`` places before in the same group (null if there is none).

        Inside a bucket this is a window; a row whose follower lies in another bucket sends one
        copy to that row's place there, so the work does not depend on ``k``.
        """
        if k == 0:
            return rows.withColumn(name, F.col(value))
        local = rows.withColumn("__local", F.lag(value, k).over(self.window())).withColumn("__halo", F.lit(False))
        there = (F.col("__p") + k).between(F.col("__to_start"), F.col("__to_end"))
        copies = self._copies(rows, [value], k, k, there, F.col("__p") + k - F.col("__to_start"))
        both = local.unionByName(copies, allowMissingColumns=True)
        # a copy sorts right before the row that wants it
        at = Window.partitionBy("__bucket").orderBy(F.asc("__at"), F.desc("__halo"))
        both = both.withColumn("__sent", F.lag(F.struct("__halo", self.group().alias("__group"), F.col(value).alias("v"))).over(at))
        meant = F.col("__sent.__halo") & F.col("__sent.__group").eqNullSafe(self.group())
        found = both.filter(~F.col("__halo")).withColumn(name, F.when(meant, F.col("__sent.v")).otherwise(F.col("__local")))
        return found.drop("__local", "__halo", "__sent")


def between_ranks(low: Column, high: Column, rank: Column) -> Column:
    """Interpolation as the built-in aggregate does it, to the last bit."""
    inner = (F.ceil(rank) - rank) * low + (rank - F.floor(rank)) * high
    return F.when((low == high) | (F.ceil(rank) == F.floor(rank)), low).otherwise(inner)


def _around(df: DataFrame, keys: list[str], values: Sequence[str], points: Sequence[float], narrow: bool) -> DataFrame:
    """One row per key, value ``__v`` and point ``__i``: its quantile ``__q``, the values counted ``__known`` and whether it was ``__missed``.

    With ``narrow``, a sketch per key bounds every point: values below are counted only, and just the few between the
    bounds are counted by value and ranked. Without, all values are.
    """
    near = [min(max(p + d, 0.0), 1.0) for p in points for d in (-SLACK / SKETCH, SLACK / SKETCH)]
    x = [F.col(f"`{v}`").cast("double") for v in values]
    aggs = {f"__known{j}": F.count(x[j]) for j in range(len(x))}
    if narrow:
        aggs |= {f"__bound{j}": F.percentile_approx(x[j], near, SKETCH) for j in range(len(x))}
    groups = {f"__g{k}": F.col(f"`{name}`") for k, name in enumerate(keys)} or {"__g0": F.lit(0)}
    rows = keyed.attach(df, groups, keyed.group_stats(df, groups, aggs))

    entries, below = [], []
    for j in range(len(x)):
        for i in range(len(points)):
            at = [F.lit(j).alias("__v"), F.lit(i).alias("__i")]
            low, high = (F.get(f"__bound{j}", F.lit(2 * i + side)) for side in (0, 1)) if narrow else (None, None)
            inside = (x[j] >= low) & (x[j] <= high) if narrow else x[j].isNotNull()
            entries.append(F.when(inside, F.struct(*at, x[j].alias("__x"), F.col(f"__known{j}").alias("__known"))))
            under = F.count_if(x[j] < low) if narrow else F.lit(0).cast("long")
            below.append(F.struct(*at, F.lit(None).cast("double").alias("__x"), F.max(f"__known{j}").alias("__known"), under.alias("__count")))
    counted = rows.select(*_columns(keys), F.explode(F.array(*entries)).alias("__e")).filter("__e is not null")
    counted = counted.select(*_columns(keys), "__e.*").groupBy(*_columns(keys), "__v", "__i", "__x")
    counted = counted.agg(F.max("__known").alias("__known"), F.count(F.lit(1)).alias("__count"))
    # what lies below comes first, as the count of a null
    under = rows.groupBy(*_columns(keys)).agg(F.array(*below).alias("__b")).select(*_columns(keys), F.inline("__b"))
    counted = tables.written(counted.unionByName(under))

    ranked = OrderedRows(counted, ["__x"], [*keys, "__v", "__i"]).with_running_sum(F.col("__count"), "__upto")
    rank = (F.col("__known") - 1) * F.get(F.array(*[F.lit(float(p)) for p in points]), F.col("__i"))
    sides = {"__low": F.floor(rank), "__high": F.ceil(rank)}
    picks = [F.max(F.when((at < F.col("__upto")) & (at >= F.col("__upto") - F.col("__count")), F.col("__x"))).alias(n) for n, at in sides.items()]
    found = ranked.groupBy(*_columns(keys), "__v", "__i").agg(F.max("__known").alias("__known"), *picks)
    missed = (F.col("__known") > 0) & (F.col("__low").isNull() | F.col("__high").isNull())
    return found.select("*", between_ranks(F.col("__low"), F.col("__high"), rank).alias("__q"), missed.alias("__missed"))


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    points: Sequence[float],
    small_group_rows: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles per key: columns ``{value}__q{i}`` for the i-th point.

    Groups whose largest row count stays below ``small_group_rows`` use the built-in exact
    aggregate, whose buffer is then bounded. Otherwise the values around a rank are found between
    bounds from a sketch, counted, laid out in order and picked, so no task ever holds a whole group
    or its distinct values; should bounds miss a rank, all values are counted and laid out.
    """
    limit = SMALL_GROUP_ROWS if small_group_rows is None else small_group_rows
    keys = list(keys)
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= limit:
        # one aggregate per column serves all points
        wanted = F.array(*[F.lit(float(p)) for p in points])
        found = df.groupBy(*keys).agg(*[F.percentile(F.col(f"`{v}`"), wanted).alias(f"__{v}") for v in values])
        return found.select(
            *keys, *[F.get(f"__{v}", F.lit(i)).alias(f"{v}__q{i}") for v in values for i in range(len(points))]
        )

    found = tables.written(_around(df, keys, values, points, narrow=True))
    if not found.filter("__missed").isEmpty():
        found = _around(df, keys, values, points, narrow=False)
    wide = [
        F.max(F.when((F.col("__v") == j) & (F.col("__i") == i), F.col("__q"))).alias(f"{v}__q{i}")
        for j, v in enumerate(values)
        for i in range(len(points))
    ]
    # every key appears, also one whose values are all null
    return df.select(*_columns(keys)).distinct().unionByName(found, allowMissingColumns=True).groupBy(*_columns(keys)).agg(*wide)
