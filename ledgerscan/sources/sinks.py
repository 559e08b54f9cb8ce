"""Writing results as files or named datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscan.functions.defaults import fill_defaults
from ledgerscan.operators.setops import append
from ledgerscan.sources import charsets

ROWS_PER_FILE = 1_000_000
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS"


def write(
    df: DataFrame, path: str, format: str = "csv", mode: str = "overwrite", rows_per_file: int | None = None, encoding: str = "UTF-8"
) -> str:
    """Writes csv, txt or tsv (tab separated), json (one record per line) or parquet files.

    ``rows_per_file`` caps the rows of every part file. Text formats get the defaults of
    :func:`fill_defaults`; parquet keeps nulls. csv, txt and tsv take any single-byte ``encoding``: what
    it does not have is written as a question mark.
    """
    df = df if format == "parquet" else fill_defaults(df)
    if not charsets.is_utf8(encoding):
        if format not in ("csv", "txt", "tsv"):
            raise ValueError(f"{format} files are written in UTF-8")
        texts = [charsets.as_latin(F.col(f"`{f.name}`").cast("string"), encoding) for f in df.schema.fields]
        df = df.select([t.alias(f.name.encode(encoding, "replace").decode("latin-1")) for t, f in zip(texts, df.schema.fields, strict=True)])
    writer = df.write.mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if format in ("csv", "txt", "tsv"):
        writer = writer.option("header", True).option("encoding", "UTF-8" if charsets.is_utf8(encoding) else "ISO-8859-1").option("escape", '"')
        # blanks at the ends of a value belong to it
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        writer.option("sep", "," if format == "csv" else "\t").option("emptyValue", "").csv(path)
    elif format == "json":
        writer.option("timestampFormat", _ISO).option("timestampNTZFormat", _ISO).json(path)
    elif format == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"Unknown output format: {format}")
    return path


def save(df: DataFrame, name: str, action: str = "new", append_to: DataFrame | None = None) -> DataFrame:
    """Registers a result as a named dataset: ``new``, ``replace`` or ``append`` to another one."""
    if action == "append" and append_to is not None:
        df = append([append_to, df])
    elif action in ("new", "replace", "append"):
        df = fill_defaults(df)
    else:
        raise ValueError(f"Unknown action: {action}")
    df.createOrReplaceTempView(f"`{name}`")
    return df
