"""A training corpus from ``documents``, in five stages; each is written as Parquet and read by the next.

Every stage works on all rows its predecessor kept and returns the columns of ``documents``, those of
the caller untouched whatever their names; the last one returns the digests of the encoded texts. Near
duplicates are told apart by row, so rows that share an id, or have none, are documents of their own;
benchmark passages are found by ``doc_id``, and rows that share one go together. Null texts are empty
texts, an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscan.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_rules
from ledgerscan.llm.common import written
from ledgerscan.llm.queries import table, tokenizer_path, trusted

#: Ids up to this number (8 bytes each) are broadcast; beyond, Spark joins by shuffle.
BROADCAST_IDS = 4_000_000


def _aside(docs: DataFrame, *more: Column) -> DataFrame:
    """Id and text, and all other columns in one, so that no result of an operator can take the place of one."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(0).alias("__none")).alias("__aside"), *more)


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select([F.col(c) if c in ("doc_id", "text") else F.col("__aside").getField(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the rules and the likelihood ratio keep."""
    return _back(quality_rules.quality_rules(_aside(docs), trusted(spark, sf_dir)).filter("kept"), docs)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of ten or more documents; ``n_chars`` follows the text."""
    found = _back(line_dedup.line_dedup(_aside(docs), min_docs=10, keep="none"), docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast("long"))
    return found


def _with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text, the others aside) with ``__row``, a number of its own for every row: file and place in it.

    Both stay the same however often and in whatever splits the files are read. What does not come from
    files is written first.
    """
    try:
        file, place = (docs.metadataColumn("_metadata").getField(f) for f in ("file_path", "row_index"))
        files = docs.select(file.alias("__file")).distinct()
    except AnalysisException:
        return _with_rows(written(docs))
    files = written(files).select("__file", F.row_number().over(Window.orderBy("__file")).alias("__at"))
    placed = _aside(docs, file.alias("__file"), place.alias("__place")).join(F.broadcast(written(files)), "__file")
    return placed.withColumn("__row", F.shiftleft(F.col("__at").cast("long"), 40) + F.col("__place")).drop("__file", "__at", "__place")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group linked by shingles of five words, 0.8 or more: the one with the smallest id, then text hash."""
    rows = _with_rows(docs)
    groups = written(jaccard_join.linked_components(rows, percent=80, shingle_words=5, id_col="__row"))
    several = written(groups.filter("doc_id <> component_id").select("component_id").distinct())
    several = F.broadcast(several) if several.count() <= BROADCAST_IDS else several
    members = groups.join(several, "component_id", "left_semi").select("component_id", F.col("doc_id").alias("__row"))
    members = rows.select("__row", "doc_id", F.xxhash64("text").alias("th")).join(members, "__row")  # id and hash, no texts
    stays = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "__row")).alias("s"))
    gone = written(members.select("__row").join(stays.select("s.__row"), "__row", "left_anti"))
    few = gone.count() <= BROADCAST_IDS
    return _back(rows.join(F.broadcast(gone) if few else gone, "__row", "left_anti"), docs)


def benchmark_overlap(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of what is left."""
    return bpe.digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", repeated_lines),
    ("jaccard_join", near_duplicates),
    ("decontaminate", benchmark_overlap),
    ("bpe", encode),
]

#: No SQL: likelihood ratios, near duplicates and BPE are beyond it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
