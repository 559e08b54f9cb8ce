"""Per-column data quality profiles.

Value statistics come from one count per (column, value), which is written once and then reduced;
moments come from one aggregate over the numeric readings; histograms and outliers take one more
pass with the bounds from the first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscan.functions import coerce as c
from ledgerscan.plans import ordered
from ledgerscan.plans.tables import written

# Texts that count as missing.
MISSING_TEXTS = ["", "nan", "None"]
POINTS = [0.05, 0.25, 0.5, 0.75, 0.95]
LIST_SIZE = 3
SMALL_VALUES = 100_000


def _chosen(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    return list(columns) if columns else df.columns


def _long(df: DataFrame, columns: Sequence[str], value) -> DataFrame:
    """(column, value) pairs; ``value(name)`` gives the value Column."""
    pairs = [F.struct(F.lit(n).alias("column"), value(n).alias("value")) for n in columns]
    return df.select(F.inline(F.array(*pairs)))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per (column, text value); missing values have a null value."""

    def shown(name: str) -> Column:
        t = c.text(name)
        return F.when(~t.isin(MISSING_TEXTS), t)

    return _long(df, _chosen(df, columns), shown).groupBy("column", "value").count()


def text_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: missing share, distinct, unique and repeated values, entropy, extremes.

    ``top_values`` / ``bottom_values`` list the three most / least frequent values as
    ``value=count`` texts joined by ``; ``. Each map task keeps three candidates per column
    (window group limit), so the ranking never gathers all values of a column.
    """
    counts = written(value_counts(df, columns))
    n, known = F.col("count"), F.col("value").isNotNull()
    filled = F.sum(F.when(known, n).otherwise(0))
    rows = F.sum(n)
    ones = F.count_if(known & (n == 1))
    spread = F.sum(F.when(known, n * F.log2(n)))
    out = counts.groupBy("column").agg(
        (F.rint((rows - filled) / rows * 100 * 100) / 100).alias("missing_pct"),
        (rows - filled).alias("null_count"),
        F.count("value").alias("distinct"),
        ones.alias("unique"),
        (filled - ones).alias("duplicate_count"),
        F.when(filled > 0, F.log2(filled) - spread / filled).otherwise(F.lit(0.0)).alias("entropy"),
    )
    for name, order in (("top_values", F.desc("count")), ("bottom_values", F.asc("count"))):
        ranked = counts.filter(known).withColumn(
            "at", F.row_number().over(Window.partitionBy("column").orderBy(order, F.asc("value")))
        )
        entry = F.concat("value", F.lit("="), n.cast("string"))
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", entry.alias("e")))), lambda s: s["e"]), "; ")
        best = ranked.filter(F.col("at") <= LIST_SIZE).groupBy("column").agg(listed.alias(name))
        out = out.join(F.broadcast(best), "column", "left")
    return out


def numeric_profile(
    df: DataFrame, columns: Sequence[str] | None = None, small_values: int = SMALL_VALUES
) -> DataFrame:
    """One row per column with numbers: moments, exact quantiles, mode, signs, outliers.

    Up to ``small_values`` distinct values the quantiles come from the built-in weighted aggregate,
    whose buffer is then bounded; beyond that from the ordered layout.
    """
    columns = _chosen(df, columns)
    numbers = _long(df, columns, lambda n: c.num(df, n)).filter("value is not null")
    numbers = written(numbers.groupBy("column", "value").count())
    x, n = F.col("value"), F.col("count")
    total = F.sum(n)
    aggs = [
        total.alias("n"),
        (F.sum(x * n) / total).alias("mean"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.max(n).alias("__most"),
        F.sum(F.when(x < 0, n).otherwise(0)).alias("negative_count"),
        F.sum(F.when(x == 0, n).otherwise(0)).alias("zero_count"),
    ]
    if numbers.count() <= small_values:
        points = F.percentile(x, F.array(*[F.lit(p) for p in POINTS]), n).alias("__points")
        first = numbers.groupBy("column").agg(*aggs, points)
        first = first.withColumns({_point_name(p): F.get("__points", F.lit(i)) for i, p in enumerate(POINTS)})
        first = first.drop("__points")
    else:
        first = numbers.groupBy("column").agg(*aggs).join(F.broadcast(weighted_quantiles(numbers, POINTS)), "column")
    # one row per column; written so that the second pass does not repeat the first
    first = written(first.withColumns({"q1": F.col("percentile_25"), "q3": F.col("percentile_75")}))
    # deviations from the known mean, so that moments do not lose digits
    d = x - F.col("mean")
    fence = F.col("q3") - F.col("q1")
    outside = (x < F.col("q1") - 1.5 * fence) | (x > F.col("q3") + 1.5 * fence)
    second = numbers.join(F.broadcast(first.withColumnRenamed("n", "__n")), "column").groupBy("column").agg(
        (F.sum(n * d * d) / total).alias("variance"),
        (F.sum(n * d * d * d) / total).alias("__m3"),
        (F.sum(n * d * d * d * d) / total).alias("__m4"),
        F.sum(F.when(outside, n).otherwise(0)).alias("outlier_count"),
        F.min(F.when(n == F.col("__most"), x)).alias("mode"),
    )
    out = first.join(F.broadcast(second), "column")
    var = F.col("variance")
    return out.select(
        "column",
        "n",
        "mean",
        F.col("percentile_50").alias("median"),
        "mode",
        F.sqrt(var).alias("std"),
        "variance",
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
        "q1",
        "q3",
        (F.col("q3") - F.col("q1")).alias("iqr"),
        "percentile_5",
        "percentile_25",
        "percentile_50",
        "percentile_75",
        "percentile_95",
        F.when((F.col("n") >= 3) & (var > 0), F.col("__m3") / F.pow(F.sqrt(var), F.lit(3.0)))
        .otherwise(F.lit(0.0))
        .alias("skewness"),
        F.when((F.col("n") >= 4) & (var > 0), F.col("__m4") / (var * var) - 3)
        .otherwise(F.lit(0.0))
        .alias("kurtosis"),
        "negative_count",
        "zero_count",
        "outlier_count",
    )


def _point_name(point: float) -> str:
    return f"percentile_{round(point * 100)}"


def weighted_quantiles(numbers: DataFrame, points: Sequence[float]) -> DataFrame:
    """Exact quantiles per column from distinct (column, value, count) rows, laid out in order.

    Totals per bucket and column (a row per bucket, plus one per column) tell in which buckets the
    wanted ranks fall; only the rows of those buckets are ranked.
    """
    rows = ordered.OrderedRows(numbers, ["value"], ["column"]).rows
    totals = rows.groupBy("__bucket", "column").agg(F.sum("count").alias("__sum"))
    per_column = Window.partitionBy("column")
    before = F.sum("__sum").over(per_column.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(
        "*", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__sum").over(per_column).alias("__n")
    )

    def ranks(p: float) -> tuple[Column, Column]:
        at = (F.col("__n") - 1) * F.lit(float(p))
        return F.floor(at), F.ceil(at)

    wanted = F.lit(False)
    for p in points:
        for rank in ranks(p):
            wanted = wanted | ((rank >= F.col("__before")) & (rank < F.col("__before") + F.col("__sum")))
    ranked = rows.join(F.broadcast(totals.filter(wanted)), ["__bucket", "column"])
    in_bucket = Window.partitionBy("__bucket", "column").orderBy("__at")
    ranked = ranked.withColumn("__upto", F.col("__before") + F.sum("count").over(in_bucket))
    picks = []
    for i, p in enumerate(points):
        for side, rank in zip(("lo", "hi"), ranks(p), strict=True):
            here = (rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("count"))
            picks.append(F.max(F.when(here, F.col("value"))).alias(f"__{side}{i}"))
    picked = ranked.groupBy("column").agg(F.max("__n").alias("__n"), *picks)
    named = []
    for i, p in enumerate(points):
        at = (F.col("__n") - 1) * F.lit(float(p))
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        named.append(ordered.between_ranks(low, high, at).alias(_point_name(p)))
    return picked.select("column", *named)


def histogram(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Equal-width bins per column with numbers: between 5 and 20 bins, about the root of the count."""
    columns = _chosen(df, columns)
    numbers = _long(df, columns, lambda n: c.num(df, n)).filter("value is not null")
    bounds = numbers.groupBy("column").agg(
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.least(F.lit(20), F.greatest(F.lit(5), F.floor(F.sqrt(F.count(F.lit(1)))))).cast("int").alias("bins"),
    )
    # a single value gets bins of total width 1 around it
    flat = F.col("low") == F.col("high")
    bounds = bounds.select(
        F.col("column").alias("__c"),
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
        "bins",
    )
    width = (F.col("high") - F.col("low")) / F.col("bins")
    guess = F.least(F.floor((F.col("value") - F.col("low")) / width), F.col("bins") - 1).cast("int")
    # the division can be off by one bin in the last digit: compare with the bin edges themselves
    edge = F.col("low") + F.col("guess") * width
    at = (
        F.when(F.col("value") < edge, F.col("guess") - 1)
        .when((F.col("value") >= edge + width) & (F.col("guess") < F.col("bins") - 1), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    counted = (
        numbers.join(F.broadcast(bounds), F.col("column") == F.col("__c"))
        .withColumn("guess", guess)
        .select("column", at.alias("bin"))
        .groupBy("column", "bin")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    bins = bounds.select(
        F.col("__c").alias("column"),
        F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"),
        "low",
        width.alias("__width"),
    )
    return bins.join(F.broadcast(counted), ["column", "bin"], "left").select(
        "column",
        "bin",
        (F.col("low") + F.col("bin") * F.col("__width")).alias("bin_start"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text and numeric profile side by side, one row per column."""
    columns = _chosen(df, columns)
    return text_profile(df, columns).join(numeric_profile(df, columns).drop("n"), "column", "left")
