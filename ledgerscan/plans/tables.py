"""Intermediate tables that are computed once and read several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL_FOLDERS: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; a local one, gone when Python ends, only for local sessions that name none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.TemporaryDirectory(prefix="ledgerscan-", ignore_cleanup_errors=True)
    return _LOCAL_FOLDERS[app].name

#: Bytes of plain values up to which a measured table is broadcast.
BROADCAST_BYTES = 64 << 20
#: Packed bytes of a range of an ordered layout, and ranges at which a planner's guess is no longer believed.
RANGE_BYTES, MOST_RANGES = 2 << 20, 20_000
VARIABLE = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType, T.VariantType)


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values: texts and nested values by their length, all others 16 each."""
    sizes = [F.lit(16 * len(df.columns))]
    for field in df.schema:
        if isinstance(field.dataType, VARIABLE):
            plain = F.col(f"`{field.name}`")
            text = plain if isinstance(field.dataType, (T.StringType, T.BinaryType)) else F.to_json(F.struct(plain))
            sizes.append(F.coalesce(F.octet_length(text), F.lit(0)))
    return sum(sizes[1:], sizes[0].cast("long"))


def fits(df: DataFrame, rows: int, size: int | None = None) -> bool:
    """Whether ``df`` (already written) has at most so many rows and bytes, by counting them (runs a job)."""
    seen = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")).first()
    return seen["rows"] <= rows and seen["bytes"] <= (BROADCAST_BYTES if size is None else size)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back.

    The copy survives the loss of executors, cuts lineage, makes partition-dependent columns
    stable, and gives the planner real file sizes to pick join strategies with.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerscan/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame) -> int:
    """Ranges for ``df``: one a ``RANGE_BYTES`` the planner expects, at least one a core.

    A task that works on a range sorts it several times, so its memory must not grow with the table; hence no
    upper bound. The planner counts packed bytes: rows may take twenty times as much in memory.
    """
    expected = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(df.sparkSession.sparkContext.defaultParallelism, min(expected // RANGE_BYTES, MOST_RANGES), 1)


def apart(spark: SparkSession, parts: int) -> list[int]:
    """``parts`` ascending numbers that lie in ``parts`` different hash buckets, so that no bucket holds two of them."""
    numbers = spark.range(60 * parts).select(F.col("id").cast("int").alias("id"))
    found = numbers.groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("slot")).agg(F.min("id").alias("id"))
    return sorted(r["id"] for r in found.collect())


def written_in_buckets(df: DataFrame, key: str, parts: int) -> DataFrame:
    """As :func:`written`, in ``parts`` hash buckets of ``key``: work partitioned by ``key`` reads it without an exchange.

    Spark knows the buckets of a table only, so the files belong to an external table while the
    frame is built; its columns have plain names there, as catalogues refuse some. The files stay.
    """
    spark = df.sparkSession
    name = f"ledgerscan_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/ledgerscan/{spark.sparkContext.applicationId}/{name}"
    plain = [f"c{i}" for i in range(len(df.columns))]
    stored = df.toDF(*plain).write.format("parquet").option("path", path)
    stored.bucketBy(parts, plain[df.columns.index(key)]).saveAsTable(name)
    table = spark.table(name).toDF(*df.columns)
    spark.sql(f"DROP TABLE {name}")
    return table
