"""Line deduplication with two Bloom filters.

Every task notes the hashes of its lines in two bit arrays: seen in one document, seen in two. Arrays
of tasks are merged shard by shard (what two tasks have both seen once is seen twice). Only lines whose
hash is in the second filter are suspects; they alone are shuffled, by their full key, to confirm the
number of documents exactly and to choose the first occurrence. A filter that is too full sends more
suspects, never a wrong result, so its size is bounded (``MAX_BITS``) whatever the corpus.

The key of a line is the line without white space at its ends and with A-Z in lower case.

Cases: a null or empty text is one empty line, which is never dropped; a document counts once for a
key it repeats; equal rows are separate documents; an empty table gives no rows; columns named like a
result are replaced, others pass through.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerscan.llm.common import prepare, text_of, without, written

#: White space at the ends of a line.
ENDS = b" \t\n\x0b\x0c\r"
BITS_PER_LINE = 8
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
HASHES = 3
SHARD_BYTES = 1 << 16
#: Confirmed keys up to this size are sent to all tasks; beyond, keys and documents meet in a join.
BROADCAST_BYTES = 32 << 20


def line_keys(text: str) -> list[bytes]:
    """The key of every line."""
    return [line.strip(ENDS) for line in text.encode("utf-8", "surrogatepass").lower().split(b"\n")]


def counted(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


class SeenFilters:
    """Bit arrays for "in one document at least" and "in two at least"."""

    def __init__(self, bits: int, once: np.ndarray | None = None, twice: np.ndarray | None = None):
        self.bits = bits
        self.once = np.zeros(bits // 8, np.uint8) if once is None else once
        self.twice = np.zeros(bits // 8, np.uint8) if twice is None else twice

    def _at(self, hashes: np.ndarray) -> np.ndarray:
        low, high = hashes & np.uint64(0xFFFFFFFF), hashes >> np.uint64(32) | np.uint64(1)
        return ((low[:, None] + high[:, None] * np.arange(HASHES, dtype=np.uint64)) & np.uint64(self.bits - 1)).astype(np.int64)

    @staticmethod
    def _set(array: np.ndarray, at: np.ndarray) -> None:
        np.bitwise_or.at(array, at.ravel() >> 3, np.left_shift(1, at.ravel() & 7).astype(np.uint8))

    @staticmethod
    def _has(array: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((array[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    def add(self, hashes: np.ndarray) -> None:
        """``hashes`` has a key once for every document that holds it."""
        if not len(hashes):
            return
        keys, times = np.unique(hashes, return_counts=True)
        at = self._at(keys)
        again = (times > 1) | self._has(self.once, at)
        self._set(self.twice, at[again])
        self._set(self.once, at)

    def suspects(self, hashes: np.ndarray) -> np.ndarray:
        return self._has(self.twice, self._at(hashes))


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64)


def _filters(rows: DataFrame, bits: int, min_chars: int) -> np.ndarray:
    """The second filter of all rows; at most ``MAX_BITS`` bits reach the driver."""
    size = min(SHARD_BYTES, bits // 8)

    def build(batches):
        seen = SeenFilters(bits)
        for batch in batches:
            keys = [k for t in batch.column(0).to_pylist() for k in {*line_keys(t)} if counted(k, min_chars)]
            seen.add(_hashes(keys))
        for shard in range(bits // 8 // size):
            once = seen.once[shard * size : (shard + 1) * size]
            if once.any():
                twice = seen.twice[shard * size : (shard + 1) * size]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([zlib.compress(once, 1)]), pa.array([zlib.compress(twice, 1)])],
                    ["shard", "once", "twice"],
                )

    def merge(batches):
        """Rows sorted by shard: one shard is held at a time."""
        at, once, twice = None, None, None

        def close():
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([zlib.compress(twice, 1)])], ["shard", "twice"])

        for batch in batches:
            for row in batch.to_pylist():
                more = np.frombuffer(zlib.decompress(row["once"]), np.uint8)
                again = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
                if row["shard"] != at:
                    if at is not None:
                        yield close()
                    at, once, twice = row["shard"], more.copy(), again.copy()
                else:
                    twice |= again | (once & more)
                    once |= more
        if at is not None:
            yield close()

    shards = rows.mapInArrow(build, "shard long, once binary, twice binary")
    shards = shards.repartition(max(1, bits // 8 // size // 4), "shard").sortWithinPartitions("shard")
    out = np.zeros(bits // 8, np.uint8)
    for row in shards.mapInArrow(merge, "shard long, twice binary").collect():
        out[row["shard"] * size : (row["shard"] + 1) * size] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out


def repeated_lines(docs: DataFrame, min_docs: int, min_chars: int, id_col: str, text_col: str) -> tuple[DataFrame, object, int]:
    """Keys of at least ``min_docs`` documents: ``key, n_docs, first`` (smallest id), written; the filter."""
    spark = docs.sparkSession
    rows = docs.select(text_of(text_col).alias("text"), F.col(f"`{id_col}`").cast("long").alias("id"))
    n_lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    lines = rows.agg(F.sum(n_lines)).first()[0] or 0
    bits = MIN_BITS
    while bits < min(MAX_BITS, lines * BITS_PER_LINE):
        bits *= 2
    twice = spark.sparkContext.broadcast(_filters(rows.select("text"), bits, min_chars))

    def suspects(batches):
        seen = SeenFilters(bits, once=np.zeros(0, np.uint8), twice=twice.value)
        for batch in batches:
            found: dict[bytes, list] = {}
            for text, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = [k for k in {*line_keys(text)} if counted(k, min_chars)]
                if not keys:
                    continue
                for k, hit in zip(keys, seen.suspects(_hashes(keys)).tolist(), strict=True):
                    if hit:
                        now = found.setdefault(k, [0, doc])
                        now[0] += 1
                        if doc is not None and (now[1] is None or doc < now[1]):
                            now[1] = doc
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*found], pa.binary()),
                    pa.array([n for n, _ in found.values()], pa.int64()),
                    pa.array([d for _, d in found.values()], pa.int64()),
                ],
                ["key", "n", "first"],
            )

    seen = rows.mapInArrow(suspects, "key binary, n long, first long")
    keys = seen.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min("first").alias("first"))
    return written(keys.filter(F.col("n_docs") >= min_docs)), twice, bits


def line_dedup(
    docs: DataFrame,
    min_docs: int = 2,
    min_chars: int = 1,
    keep: str = "first",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, plus ``n_lines`` and ``n_dropped``.

    A key found in ``min_docs`` documents or more loses its lines: all of them (``keep="none"``), or
    all but the first line with that key in the document with the smallest id (``keep="first"``; rows
    that share an id are one document).
    """
    if keep not in ("first", "none"):
        raise ValueError("keep is 'first' or 'none'")
    spark = docs.sparkSession
    prepare(spark)
    confirmed, twice, bits = repeated_lines(docs, min_docs, min_chars, id_col, text_col)
    size = confirmed.agg(F.sum(F.length("key") + 100)).first()[0] or 0
    rest = without(docs, "n_lines", "n_dropped", "__id", "__text", "__keys")
    rows = rest.withColumn("__id", F.col(f"`{id_col}`").cast("long")).withColumn("__text", text_of(text_col))
    names = rest.columns
    fields = [StructField(f.name, StringType()) if f.name == text_col else f for f in rest.schema.fields]
    place = names.index(text_col)

    def apply(batches, first_of):
        for batch in batches:
            texts, totals, dropped = [], [], []
            for row, (text, doc) in enumerate(zip(batch.column("__text").to_pylist(), batch.column("__id").to_pylist(), strict=True)):
                lines, keys, gone = text.split("\n"), line_keys(text), first_of(batch, row)
                seen: set[bytes] = set()
                stay = []
                for line, key in zip(lines, keys, strict=True):
                    drop = key in gone
                    if drop and keep == "first" and gone[key] == doc and key not in seen:
                        drop = False
                    seen.add(key)
                    if not drop:
                        stay.append(line)
                texts.append("\n".join(stay))
                totals.append(len(lines))
                dropped.append(len(lines) - len(stay))
            columns = [batch.column(n) for n in names]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"]
            )

    out = StructType([*fields, StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    if size <= BROADCAST_BYTES:
        table = spark.sparkContext.broadcast({bytes(r["key"]): r["first"] for r in confirmed.collect()})
        return rows.mapInArrow(lambda batches: apply(batches, lambda batch, row: table.value), out)

    # many confirmed keys: suspects of every distinct text meet them in a join, by the full key
    def occurrences(batches):
        seen = SeenFilters(bits, once=np.zeros(0, np.uint8), twice=twice.value)
        for batch in batches:
            for text, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys = [k for k in {*line_keys(text)} if counted(k, min_chars)]
                hits = [k for k, hit in zip(keys, seen.suspects(_hashes(keys)).tolist(), strict=True) if hit] if keys else []
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(hits)), pa.array(hits, pa.binary())], ["digest", "key"])

    digest = F.sha2(text_of(text_col), 256)
    met = docs.select(text_of(text_col).alias("text"), digest.alias("digest"))
    met = met.mapInArrow(occurrences, "digest string, key binary").distinct().join(confirmed, "key")
    met = met.groupBy("digest").agg(F.collect_list(F.struct("key", "first")).alias("__keys"))
    joined = rows.withColumn("__digest", digest).join(met, F.col("__digest") == F.col("digest"), "left").drop("__digest", "digest")

    def own(batch, row):
        found = batch.column("__keys")[row].as_py() or []
        return {bytes(k["key"]): k["first"] for k in found}

    return joined.mapInArrow(lambda batches: apply(batches, own), out)


def digests(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256`` after lines of ``min_docs`` documents are gone."""
    found = line_dedup(docs.select("doc_id", "text"), min_docs=min_docs, keep="none")
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
