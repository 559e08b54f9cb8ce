"""Delimited text: line breaks in quotes without one task per file, a header per file, any line-wise charset.

Spark's text source cuts files into byte ranges and gives whole lines. Whether a line begins inside quotes
depends on all lines before it, but a line only maps one bit to one bit: open or not before, open or not
behind. Ranges are therefore scanned on their own. Each line gets its map (``line_maps``); inside a range a
window composes them, one row per range is composed over the ranges of a file, and that gives the true state
at every place (``open_lines``). Lines inside quotes join the record that began before them; a record is then
parsed by Spark's own parser as an expression, wherever it lies.

Only lines that hold a quote take part in the scan, and only lines of records with line breaks are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscan.plans.tables import BROADCAST_BYTES, written
from ledgerscan.sources import charsets

#: Places of lines (a path and two numbers each) up to this number are broadcast; beyond, lines and places are joined by sorting.
BROADCAST_LINES = 200_000


def raw_lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """``file, block, line``: every line, decoded, with its file and where its byte range starts."""
    text = charsets.decoded(F.col("value").cast("binary"), encoding)
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), text.alias("line"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``file, block, no, line``: lines with their 0-based number in the file; written once.

    A range numbers its lines while they are written; the sizes of the ranges before it give its first number.
    """
    placed = written(lines.withColumn("at", F.monotonically_increasing_id()))
    sizes = placed.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = placed.join(F.broadcast(starts), ["file", "block"])
    return numbered.select("file", "block", (F.col("at") - F.col("first") + F.col("base")).alias("no"), "line")


def line_maps(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether quotes are open behind a line, if they are not before it, and if they are.

    A quote opens a value only where one begins; two in a row change nothing; the next one closes it.
    """
    single = F.concat(F.lit(sep), F.replace(line, F.lit('""'), F.lit("")))
    between = F.split(single, '"')
    ahead = F.slice(between, 1, F.size(between) - 1)

    def behind(start: bool) -> Column:
        return F.aggregate(ahead, F.lit(start), lambda open_, part: ~open_ & part.endswith(sep))

    return behind(False), behind(True)


def _composed(maps: DataFrame, *within: str) -> DataFrame:
    """``maps`` with the map of all rows up to each one, as ``flips`` so far and the ``last`` row that fixes the state.

    A row that ends alike from both starts fixes the state; rows behind the last such row keep or flip it.
    """
    window = Window.partitionBy(*within[:-1]).orderBy(within[-1]).rowsBetween(Window.unboundedPreceding, 0)
    counted = maps.withColumn("flips", F.sum((F.col("out") & ~F.col("in")).cast("int")).over(window))
    fixed = F.when(F.col("out") == F.col("in"), F.struct(F.col("out").alias("state"), "flips"))
    return counted.withColumn("last", F.last(fixed, ignorenulls=True).over(window))


def _after(last: Column, flips: Column, start: Column) -> Column:
    """The state behind rows, given their last fixed one, their flips and the state in front of them."""
    since = F.when(last.isNull(), flips).otherwise(flips - last.getField("flips"))
    state = F.when(last.isNull(), start).otherwise(last.getField("state"))
    return state != (since % 2 == 1)


def open_lines(lines: DataFrame, sep: str) -> DataFrame:
    """``file, first, last``: records of more than one line. A quote that is never closed ends with its line."""
    out, in_ = line_maps(F.col("line"), sep)
    maps = lines.filter(F.contains("line", F.lit('"'))).select("file", "block", "no", out.alias("out"), in_.alias("in"))
    maps = written(maps.filter(F.col("out") | ~F.col("in")))  # others change nothing
    scanned = _composed(maps, "file", "block", "no")

    # one row per range: its map, composed over the ranges of the file
    whole = scanned.groupBy("file", "block").agg(F.max_by(F.struct("flips", "last"), "no").alias("end"))
    ends = {n: _after(F.col("end.last"), F.col("end.flips"), F.lit(start)) for n, start in (("out", False), ("in", True))}
    whole = _composed(whole.select("file", "block", *[c.alias(n) for n, c in ends.items()]), "file", "block")
    whole = whole.withColumn("state", _after(F.col("last"), F.col("flips"), F.lit(False)))
    entry = F.lag("state", 1, False).over(Window.partitionBy("file").orderBy("block"))
    entries = whole.select("file", "block", entry.alias("entry"))

    states = scanned.join(F.broadcast(entries), ["file", "block"])
    states = states.withColumn("after", _after(F.col("last"), F.col("flips"), F.col("entry")))
    before = F.coalesce(F.lag("after").over(Window.partitionBy("file", "block").orderBy("no")), F.col("entry"))
    turns = written(states.withColumn("before", before).filter("before <> after").select("file", "block", "no"))

    # openings and closings alternate: the k-th opening belongs to the k-th closing
    sizes = turns.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(sizes.select("file", "block", base.alias("base")))
    rank = F.row_number().over(Window.partitionBy("file", "block").orderBy("no")) - 1
    pairs = turns.withColumn("rank", rank).join(bases, ["file", "block"]).withColumn("pair", F.floor((F.col("rank") + F.col("base")) / 2))
    found = pairs.groupBy("file", "pair").agg(F.min("no").alias("first"), F.max("no").alias("last"))
    return found.filter("last > first").select("file", "first", "last")


def records(lines: DataFrame, sep: str) -> DataFrame:
    """``file, no, record``: lines, with those inside quotes joined to the line where the quotes opened."""
    spans = written(open_lines(lines, sep))
    if spans.isEmpty():
        return lines.select("file", "no", F.col("line").alias("record"))
    places = spans.select(F.col("file").alias("__file"), F.col("first").alias("__first"), F.explode(F.sequence("first", "last")).alias("__no"))
    many = F.col("last") - F.col("first") + 1
    count, size = spans.agg(F.sum(many), F.sum(many * (F.octet_length("file") + 48))).first()
    # the planner knows the packed size of the spans only and would broadcast millions of places unasked
    places = F.broadcast(places) if count <= BROADCAST_LINES and size <= BROADCAST_BYTES else places.hint("merge")
    tagged = lines.join(places, (lines.file == places["__file"]) & (lines.no == places["__no"]), "left")
    alone = tagged.filter("__first is null").select("file", "no", F.col("line").alias("record"))
    joined = tagged.filter("__first is not null").groupBy("file", F.col("__first").alias("no"))
    parts = F.array_sort(F.collect_list(F.struct(F.col("no").alias("at"), "line")))
    joined = joined.agg(F.array_join(parts.getField("line"), "\n").alias("record"))
    return alone.unionByName(joined)


def parsed(rows: DataFrame, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """The values of ``record`` by Spark's parser, each record parsed once."""
    kept = [F.col(c) for c in rows.columns if c != "record"]
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)
    return rows.select(*kept, F.inline(F.array(F.from_csv("record", ddl, options))))
