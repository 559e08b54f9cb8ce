"""Quality by importance resampling.

Two generative models over hashed n-grams (words, their signs and neighbouring words), one of trusted
documents and one of the whole corpus, give every document a log importance weight: the sum of the
log ratios of its n-grams. A sample without replacement by these weights is the top k of weight plus
Gumbel noise; the noise is a hash of the row, so a run repeats. The k-th key is found exactly by
counting keys in ever finer ranges, so nothing is gathered or sorted in one place.

Counts are taken in every task and summed by Spark, over all documents.

Cases: a null or empty text has weight 0; equal keys are told apart by the hash of the row, and rows
equal in id and text are kept or left together; k beyond the rows keeps all; without trusted
documents all weights are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscan.llm.common import Memory, prepare, text_of, written

BUCKETS = 10_000
SMOOTHING = 1.0
SEED = 17
KNOWN_WORDS = 300_000
SIGNS = ".,!?;:%&$#*|\"'()[]{}<>-"
#: Trusted ids up to this number (8 bytes each) are broadcast; beyond, Spark joins by shuffle.
BROADCAST_IDS = 4_000_000
_RANGES = 1 << 12
_C = np.uint64(0x94D049BB133111EB)


def word_hashes(word: str) -> tuple[int, int]:
    """Hashes of a word and of the signs at its end (0 for none)."""
    core = word.rstrip(SIGNS)
    tail = word[len(core) :]
    return xxhash.xxh3_64_intdigest(core.lower()), xxhash.xxh3_64_intdigest(f"s{tail}") | 1 if tail else 0


def grams(text: str, known: Memory) -> np.ndarray:
    """Buckets of the n-grams of a text."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64)
    pairs = np.array([known[w] for w in words], np.uint64)
    cores, tails = pairs[:, 0], pairs[:, 1]
    both = (cores[:-1] * _C) ^ (cores[1:] + (cores[:-1] >> np.uint64(7)))
    return (np.concatenate([cores, tails[tails > 0], both]) % np.uint64(BUCKETS)).astype(np.int64)


def ratios(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Log ratio of every bucket; the driver gets one row per bucket."""
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("t")).filter("t is not null").distinct()
    ids = written(ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), text_of(text_col).alias("text"))
    rows = rows.join(ids, F.col("i") == F.col("t"), "left").select(F.col("t").isNotNull().alias("good"), "text")

    def count(batches):
        known, raw, target = Memory(word_hashes, KNOWN_WORDS), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for good, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(grams(text, known), minlength=BUCKETS)
                raw += found
                if good:
                    target += found
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(target), pa.array(raw)], ["b", "target", "raw"])

    counts = rows.mapInArrow(count, "b long, target long, raw long").groupBy("b").agg(F.sum("target"), F.sum("raw"))
    table = np.zeros((2, BUCKETS))
    for b, target, raw in counts.collect():
        table[:, b] = target, raw
    if not table[0].sum():
        return np.zeros(BUCKETS)
    shares = (table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * BUCKETS)
    return np.log(shares[0] / shares[1])


def with_weights(docs: DataFrame, table: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, log_weight, key, at``: Gumbel key of every row, and its place as an orderable long."""
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        known, table = Memory(word_hashes, KNOWN_WORDS), sent.value
        for batch in batches:
            weights, keys = [], []
            for row, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                weight = float(table[grams(text, known)].sum())
                uniform = ((row & 0xFFFFFFFFFFFFF) + 0.5) / (1 << 52)
                weights.append(weight)
                keys.append(weight - float(np.log(-np.log(uniform))))
            bits = np.array(keys, np.float64).view(np.int64)
            at = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)  # longs in the order of the keys
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(weights), pa.array(keys), pa.array(at)], ["doc_id", "row", "log_weight", "key", "at"]
            )

    text = text_of(text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(F.lit(SEED), f"`{id_col}`", text).alias("row"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, log_weight double, key double, at long")


def kth(rows: DataFrame, column: str, k: int) -> tuple[int, int]:
    """The ``k``-th largest long of a column and how many are larger: counts in ranges, 12 bits a pass."""
    low, larger = -(1 << 63), 0
    for shift in (52, 40, 28, 16, 4, 0):
        part = F.shiftright(F.col(column), shift)
        counts = rows.groupBy(part.alias("part")).count().orderBy(F.desc("part")).collect()  # at most 4096 rows
        for r in counts:
            if larger + r["count"] >= k:
                low = r["part"]
                break
            larger += r["count"]
        rows = rows.filter(part == low)
    return low, larger


def importance_sample(
    docs: DataFrame, trusted: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, log_weight, gumbel_key, kept`` of every row; ``kept`` marks the sample of ``k`` rows."""
    prepare(docs.sparkSession)
    rows = written(with_weights(docs, ratios(docs, trusted, id_col, text_col), id_col, text_col))
    total = rows.count()
    kept = F.lit(True)
    if k <= 0:
        kept = F.lit(False)
    elif k < total:
        bound, larger = kth(rows, "at", k)
        tied = rows.filter(F.col("at") == bound)
        last, _ = kth(tied, "row", k - larger)
        kept = (F.col("at") > bound) | ((F.col("at") == bound) & (F.col("row") >= last))
    return rows.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), kept.alias("kept"))


def trusted_share(labels: DataFrame, column: str = "quality") -> float:
    """Share of trusted documents among the labelled ones: how much of the corpus is worth a place."""
    good, every = labels.agg(F.count_if(F.col(column) == 1), F.count(column)).first()
    return good / every if every else 1.0
