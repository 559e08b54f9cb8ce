"""File readers. Everything is read as text, with real nulls, by Spark's own distributed sources."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscan.plans.tables import written
from ledgerscan.sources import charsets, delimited
from ledgerscan.sources.schema import clean_columns, make_unique

_EXTRA = "__beyond_last_column"
SEPARATORS = (",", ";", "\t", "|")


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(
    spark: SparkSession,
    path: str,
    sep: str | None = None,
    encoding: str = "UTF-8",
    skiprows: int = 0,
    header_row: int = 0,
    multiline: bool = True,
) -> DataFrame:
    """Delimited text with a header; lines with too many fields are left out, short ones padded.

    Without ``sep`` the separator is the most frequent of comma, semicolon, tab and bar in the first
    line. Every file of a folder has its own header: files are united by column name, columns that a
    file lacks are null. ``skiprows`` leaves out the lines 1..n of each file, ``header_row`` is the
    0-based line of the header among the others; lines in front of it are left out as well.

    ``encoding`` is any single-byte set, UTF-8, or one that Spark knows. Line breaks inside quotes are
    read whatever the size of the file (see ``delimited``), unless ``multiline`` is false.

    One pass over the lines runs here, for headers and for quotes left open at the end of a line. Where there
    are none, Spark's own reader reads the files in ranges; otherwise lines are numbered and written
    once. Files in UTF-16 or UTF-32 cannot be cut into lines: each is one task, with one header for all.
    """
    if not charsets.by_lines(encoding):
        return _read_whole(spark, path, sep, encoding, skiprows + header_row)
    header_at = skiprows + header_row if header_row else 0
    lines = delimited.raw_lines(spark, path, encoding)
    if header_at or skiprows:
        lines = delimited.numbered_lines(lines)
        lines = lines.filter((F.col("no") == header_at) | (F.col("no") > skiprows + header_row))
    firsts, open_by = _looked_over(lines, header_at, (sep,) if sep else SEPARATORS, multiline)
    sep = sep or _separator(firsts)
    options = {"sep": sep, "quote": '"', "escape": '"'}
    if open_by[sep]:
        lines = lines if "no" in lines.columns else delimited.numbered_lines(lines)
        rows = written(delimited.records(lines, sep))
        firsts = {r["file"]: r["record"] for r in rows.filter(F.col("no") == header_at).collect()}  # one record per file
    else:
        rows = lines.withColumnRenamed("line", "record")
    heads = _headers(spark, firsts, options)
    parts = []
    for names in dict.fromkeys(heads[f] for f in sorted(heads)):
        files = [f for f in heads if heads[f] == names]
        schema = _strings([*names, _EXTRA])
        if "no" in rows.columns:
            some = rows.filter(F.col("file").isin(files)) if len(files) < len(heads) else rows
            some = some.filter((F.col("no") != header_at) & (F.trim("record") != "")).select("record")
            part = delimited.parsed(some, schema, {**options, "mode": "PERMISSIVE"})
        else:
            part = _by_spark(spark, path, encoding, schema, options, files if len(files) < len(heads) else None)
        parts.append(part.filter(F.col(_EXTRA).isNull()).drop(_EXTRA))
    if not parts:
        return spark.createDataFrame([], T.StructType([]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _looked_over(lines: DataFrame, header_at: int, seps: tuple[str, ...], multiline: bool) -> tuple[dict[str, str], dict[str, bool]]:
    """In one pass: the header line of every file, and for each separator whether a line ends inside quotes."""
    if "no" in lines.columns:
        at = F.when(F.col("no") == header_at, F.col("no"))
    else:
        lines = lines.withColumn("at", F.monotonically_increasing_id())
        at = F.when(F.col("block") == 0, F.col("at"))
    opens = [F.when(F.contains("line", F.lit('"')), delimited.line_maps(F.col("line"), s)[0]) if multiline else F.lit(False) for s in seps]
    found = lines.groupBy("file").agg(F.min_by("line", at).alias("line"), *[F.coalesce(F.bool_or(o), F.lit(False)).alias(f"open{k}") for k, o in enumerate(opens)])
    seen = found.collect()  # one row per file
    firsts = {r["file"]: r["line"] for r in seen if r["line"] is not None}
    return firsts, {s: any(r[f"open{k}"] for r in seen) for k, s in enumerate(seps)}


def _separator(firsts: dict[str, str]) -> str:
    """The most frequent separator in the first header, outside quotes."""
    bare = re.sub(r'"[^"]*"', "", firsts[min(firsts)]) if firsts else ""
    return max(SEPARATORS, key=bare.count)


def _headers(spark: SparkSession, firsts: dict[str, str], options: dict) -> dict[str, tuple[str, ...]]:
    """The column names of every file, read from its header as any record."""
    kinds = sorted({h.lstrip("\ufeff") for h in firsts.values()})
    if not kinds:
        return {}
    # a header has at most one field more than separators, and one column more shows none is lost
    width = max(h.count(options["sep"]) for h in kinds) + 1
    table = spark.createDataFrame([(h,) for h in kinds], "record string")
    fields = delimited.parsed(table.withColumn("head", F.col("record")), _strings([f"f{k}" for k in range(width)]), options)
    names = {}
    for row in fields.collect():
        own = [*row][1:]
        while len(own) > 1 and own[-1] is None and len(own) > _fields(row["head"], options["sep"]):
            own.pop()
        names[row["head"]] = tuple(make_unique(own))
    return {file: names[h.lstrip("\ufeff")] for file, h in firsts.items()}


def _fields(header: str, sep: str) -> int:
    """Fields of a header: separators outside quotes, and one."""
    return re.sub(r'"(?:[^"]|"")*"', "", header).count(sep) + 1


def _by_spark(spark: SparkSession, path: str, encoding: str, schema: T.StructType, options: dict, files: list[str] | None) -> DataFrame:
    """Spark's own reader, which cuts files without line breaks in quotes into ranges; ``files`` are picked by its listing."""
    utf8 = charsets.is_utf8(encoding)
    reader = spark.read.options(**options).option("header", True).option("enforceSchema", True)
    df = reader.option("encoding", "UTF-8" if utf8 else "ISO-8859-1").schema(schema).option("mode", "PERMISSIVE").csv(path)
    df = df.filter(F.col("_metadata.file_path").isin(files)) if files else df
    names = [F.col(f"`{f.name}`") for f in schema.fields]
    return df.select([n if utf8 else charsets.translated(n, encoding).alias(f.name) for n, f in zip(names, schema.fields, strict=True)])


def _read_whole(spark: SparkSession, path: str, sep: str | None, encoding: str, skipped: int) -> DataFrame:
    if skipped:
        raise ValueError(f"skiprows and header_row need files that can be cut into lines; {encoding} cannot")
    first = spark.read.option("encoding", encoding).option("sep", "\0").option("quote", "").csv(path).first()
    options = {"sep": sep or _separator({"": (first[0] or "") if first else ""}), "encoding": encoding, "quote": '"', "escape": '"', "multiLine": "true"}
    row = spark.read.options(**options).option("header", False).csv(path).first()
    names = [n.lstrip("\ufeff") if n else n for n in row] if row else []
    schema = _strings([*make_unique(names), _EXTRA])
    reader = spark.read.options(**options).schema(schema).option("mode", "PERMISSIVE")
    heads = reader.csv(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]).alias("head"))
    if heads.groupBy("file").agg(F.min_by("head", "at").alias("head")).select("head").distinct().count() > 1:
        raise ValueError(f"files in {encoding} with different headers: read them one by one")
    df = reader.option("header", True).option("enforceSchema", True).csv(path)
    return df.filter(F.col(_EXTRA).isNull()).drop(_EXTRA)


def read_json(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """A JSON array, a JSON object, or one object per line (unreadable lines are left out)."""
    if lines is None:
        start = spark.read.text(path).filter(F.trim("value") != "").first()
        text = start[0].strip() if start else ""
        lines = text.startswith("{") and text.endswith("}")
    if lines:
        names = spark.read.option("mode", "DROPMALFORMED").option("primitivesAsString", True).json(path).columns
        df = spark.read.schema(_strings(names)).option("mode", "DROPMALFORMED").json(path)
    else:
        df = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
        df = df.select([F.col(f"`{n}`").cast("string").alias(n) for n in df.columns])
    return clean_columns(df)


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """One row per ``row_tag`` element: child texts as columns, attributes as ``@name``."""
    df = (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("attributePrefix", "@")
        .option("valueTag", "value")
        .option("inferSchema", False)
        .option("ignoreSurroundingSpaces", True)
        .load(path)
    )
    return df.select([F.col(f"`{n}`").cast("string").alias(n) for n in df.columns])


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_any(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """Reader chosen by the file extension (or ``format``); anything unknown is read as CSV."""
    kind = (format or os.path.splitext(path.rstrip("/"))[1].lstrip(".")).lower()
    if kind == "parquet":
        return read_parquet(spark, path)
    if kind in ("json", "jsonl"):
        return read_json(spark, path, **({"lines": True} if kind == "jsonl" else {}), **options)
    if kind == "xml":
        return read_xml(spark, path, **options)
    if kind in ("tsv", "txt") and (kind == "tsv" or format):
        options.setdefault("sep", "\t")
    return read_csv(spark, path, **options)
