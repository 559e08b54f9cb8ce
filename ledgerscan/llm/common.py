"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import ledgerscan
from ledgerscan.plans.tables import shared_folder, written

__all__ = ["shared_folder", "written", "Memory", "packed", "prepare", "text_of", "without", "WHITE_SPACE", "white_words"]

#: The white space that separates words in all contracts.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Documents are up to hundreds of kilobytes, so Python workers get few of them at a time.
ROWS_PER_BATCH = 256
_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}


def prepare(spark: SparkSession) -> None:
    """Makes Python workers ready: this package on their path, and few texts in an Arrow batch.

    The package is shipped by Spark once per application, as ``--py-files`` would do. A batch size that
    the user has set is left alone.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(ROWS_PER_BATCH))
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        home = Path(ledgerscan.__file__).parent
        folder = _SHIPPED[context.applicationId] = tempfile.TemporaryDirectory(prefix="ledgerscan-")  # until Python ends
        name = f"{folder.name}/ledgerscan_package.zip"
        with zipfile.ZipFile(name, "w") as out:
            for file in sorted(home.rglob("*.py")):
                out.write(file, str(file.relative_to(home.parent)))
        context.addPyFile(name)


def packed(df: DataFrame) -> DataFrame:
    """Like ``written``, compressed harder: for tables about as large as the corpus."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ledgerscan/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(name: str) -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns whose names an operator gives to its own results."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def white_words(text: Column) -> Column:
    """Words of a text: everything between white space; an empty array for no text.

    Plain replacements and a split at one letter, which run several times faster than a pattern.
    """
    text = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


class Memory(dict):
    """Results by key, bounded in bytes: first ones stay (frequent keys come early), later ones pass through.

    ``limit`` is a number of entries of ``ENTRY`` bytes; larger entries take the room of several.
    """

    ENTRY = 200

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.recent = compute, {}
        self.room, self.passing = limit * self.ENTRY, limit * self.ENTRY // 8
        self.left = self.passing

    def __missing__(self, key):
        found = self.recent.get(key)
        if found is None:
            found = self.compute(key)
            self.keep(key, found)
        return found

    def keep(self, key, found) -> None:
        size = 100 + sys.getsizeof(key) + sys.getsizeof(found)
        if self.room >= size:
            self.room -= size
            self[key] = found
            return
        if self.left < size:
            self.recent.clear()
            self.left = self.passing
        if size <= self.left:
            self.left -= size
            self.recent[key] = found
