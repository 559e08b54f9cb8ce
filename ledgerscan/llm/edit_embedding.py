"""Document fingerprints: shared random walks turn edit distance into Hamming distance of sampled symbols.

A walk reads a text character by character. At every step it puts out the character under its pointer
and moves on, or stays, by a random bit that depends on nothing but the step and the character - so all
texts share it. Texts that differ by an edit often fall into step again behind it, but not always soon.
Walks therefore start anew at places that the text itself marks (an eight-letter string with a small
hash, about every ``STRETCH`` characters), and what an edit throws out of step ends at the next mark.

An output is a set of (mark, step, character). A fingerprint samples ``SAMPLES`` of them, the one with
the smallest shared priority in each part of the hash range, and keeps a byte of each (00 where a short
text has none). Equal bytes estimate the share of equal output, hence how many characters the texts have
in common (``likeness``): every character of a whole text can be sampled, at any length.

``near_copies`` cuts fingerprints into bands of sampled bytes, so narrow that fingerprints of likeness ``least``
always share one; entries that share a band are compared by whole fingerprints, first with one representative, then
across the classes that this leaves. No pair of ``least`` or more ends in two classes.

Defined results: null texts are empty; empty texts have the fingerprint of zeros, alike (1) to each other
and to nothing else; equal texts have equal fingerprints; documents of one id stand in the order of their
text hash; a null id comes first; the last document is followed by the first (a lone one by itself); an
empty table gives no rows; of the caller's columns only id and text are read, so others cannot clash.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscan.llm.common import prepare, text_of, without, written
from ledgerscan.llm.components import connected_components
from ledgerscan.plans.tables import written_in_buckets

#: Samples of a fingerprint, one byte each.
SAMPLES = 128
#: Letters of the strings that can be marks, and characters from mark to mark on average.
GRAM, STRETCH = 8, 32
#: Random bits repeat after this many steps; characters are told apart in so many classes by a walk.
PERIOD, CLASSES = 1 << 12, 256
#: Characters that are fingerprinted in one go.
PACK_CHARS = 1 << 20
#: Entries of a cell that are compared in one task; larger cells are compared in pairs of such blocks.
BLOCK = 16_384
#: Fingerprints that one is compared with in one go.
COMPARED = 4_096
#: Ranges of documents for each shuffle partition, and keys drawn for each range to place their bounds.
RANGES, KEYS = 8, 16
#: Bits of a cell's hash: entries of a cell are compared by whole fingerprints, so others with its hash cost time only.
CELL_BITS = 40
#: Hexadecimal results, moved and written as bytes.
DIGITS = ("edited_sha256", "fingerprint", "edited_fingerprint")

_CHANCE = 1 / 255
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit integers that looks random (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def moves() -> np.ndarray:
    """``[class, step]``: whether a pointer on a character of the class moves on after that step."""
    return (_mix(np.arange(1, CLASSES * PERIOD + 1, dtype=np.uint64) * _ODD) >> np.uint64(63)).astype(bool).reshape(CLASSES, PERIOD)


@cache
def stays() -> np.ndarray:
    """``[class, step]``: steps that a character of the class takes when it is reached at the step."""
    out = np.zeros((CLASSES, PERIOD), np.int64)
    after = np.zeros(CLASSES, np.int64)
    for t in [*range(PERIOD)][::-1] * 2:
        after = np.where(moves()[:, t], 1, after + 1)
        out[:, t] = after
    return out


def classes(codes: np.ndarray) -> np.ndarray:
    """The class of every code point."""
    return (codes.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24)


def marks(codes: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` letters from every place on (0 where there are fewer)."""
    grams, size, factor = codes.astype(np.uint64) + np.uint64(1), 1, 0x100000001B3
    while size < GRAM:
        grams = grams[:-size] * np.uint64(factor) + grams[size:] if len(grams) > size else grams[:0]
        size, factor = 2 * size, factor * factor % (1 << 64)
    out = np.zeros(len(codes), np.uint64)
    out[: len(grams)] = _mix(grams * _ODD) | np.uint64(1)
    return out


def walk(kinds: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The step at which every character is reached; all stretches walk in lockstep, the longest ones last."""
    table, mask = stays().reshape(-1), PERIOD - 1
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    reached = np.empty(len(kinds), np.int64)
    rows = kinds.astype(np.int64) * PERIOD
    now, at, done = np.zeros(len(sizes), np.int64), starts.copy(), 0
    while len(at):
        for _ in range(done, int(sizes[-1])):
            reached[at] = now
            now += table[rows[at] + (now & mask)]
            at += 1
        done = int(sizes[-1])
        active = int(np.searchsorted(-sizes, -done, "left"))
        now, at, sizes = now[:active], at[:active], sizes[:active]
    return reached


def fingerprints_of(texts: list[str]) -> list[np.ndarray]:
    """The bytes of every text's fingerprint."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    filled = [c for c in codes if len(c)]
    if not filled:
        return [np.zeros(SAMPLES, np.uint8) for _ in codes]
    with np.errstate(over="ignore"):
        every = np.concatenate(filled)
        grams = np.concatenate([marks(c) for c in filled])
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in filled])])
        fresh = (grams > 0) & (grams < np.uint64((1 << 64) // STRETCH))
        grams[bounds[:-1]] = np.uint64(1)  # the start of a text is a mark of its own
        fresh[bounds[:-1]] = True
        starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(starts, len(every)))
        reached = walk(classes(every), starts, sizes)
        anchors = np.repeat(grams[starts], sizes)
        output = _mix(_mix(anchors + reached.astype(np.uint64) * _ODD) + every.astype(np.uint64) * _ODD)
    parts = (np.arange(SAMPLES, dtype=np.uint64) * np.uint64((1 << 64) // SAMPLES)).astype(np.uint64)
    found, place = [], 0
    for c in codes:
        if not len(c):
            found.append(np.zeros(SAMPLES, np.uint8))
            continue
        drawn = np.sort(output[bounds[place] : bounds[place + 1]])
        place += 1
        first = np.searchsorted(drawn, parts)
        least = drawn[np.minimum(first, len(drawn) - 1)]
        inside = (first < len(drawn)) & (least // np.uint64((1 << 64) // SAMPLES) == np.arange(SAMPLES))
        found.append(np.where(inside, 1 + least % np.uint64(255), 0).astype(np.uint8))
    return found


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the characters that two texts have in common, 0 to 1, from their fingerprints.

    Equal samples (less those equal by chance) estimate the common part of both outputs over all of them.
    """
    taken = int(np.count_nonzero((a > 0) | (b > 0)))
    if not taken:
        return 1.0
    same = int(np.count_nonzero((a == b) & (a > 0))) / taken
    common = max(0.0, (same - _CHANCE) / (1 - _CHANCE))
    return 2 * common / (1 + common)


# -- documents and their successors ----------------------------------------------------------------


def _dealt(df: DataFrame) -> DataFrame:
    """``bucket, tail, id, h, text`` (packed): ranges of ascending ids, each closed by the first document of the next.

    The bounds are ids that a pass over ids and text hashes draws evenly; each bound is itself a document,
    hence the first one of its range, and goes to the range before as its tail as well. Neither
    rows nor ids are collected but for ``KEYS`` drawn keys a range.
    """
    spark = df.sparkSession
    ranges = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = df.select("id", F.xxhash64("text").alias("h"))
    every = max(1, df.count() // (KEYS * ranges))
    drawn = keys.filter(F.pmod(F.xxhash64("id", "h", F.lit(7)), F.lit(every)) == 0).distinct().collect()
    least = keys.orderBy(F.col("id").asc_nulls_first(), "h").limit(1).collect()

    def key(value, h):
        return (value is not None, value if value is not None else 0, h)

    first = key(*least[0]) if least else None
    bounds = sorted({key(*r) for r in drawn} - {first})
    bounds = bounds[:: max(1, len(bounds) // ranges)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            ids, hashes = batch.column("id").to_pylist(), batch.column("h").to_pylist()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            bucket, tail, row = [], [], []
            for k, pair in enumerate(zip(ids, hashes)):
                place = key(*pair)
                at = bisect.bisect_right(bounds, place)
                bucket.append(at)
                tail.append(False)
                row.append(k)
                before = at - 1 if at and bounds[at - 1] == place else len(bounds) if place == first else None
                if before is not None:
                    bucket.append(before)
                    tail.append(True)
                    row.append(k)
            packed = [packer.compress(t) for t in texts]
            taken = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int64()), pa.array(tail, pa.bool_()), batch.column("id").take(taken), batch.column("h").take(taken), pa.array([packed[k] for k in row], pa.binary())],
                names=["bucket", "tail", "id", "h", "text"],
            )

    given = df.select("id", F.xxhash64("text").alias("h"), "text")
    kind = df.schema["id"].dataType.simpleString()
    dealt = given.mapInArrow(work, f"bucket long, tail boolean, id {kind}, h long, text binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "tail", F.col("id").asc_nulls_first(), "h")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``n_chars``, its fingerprint, and how near it is to its edited text and to the next document.

    The ``edited`` text has the last half (rounded down) of the code points replaced by as many, or all,
    first ones of the next document in ascending id order.
    """
    prepare(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = zstandard.ZstdDecompressor()
        id_type = None
        held: list[tuple] = []  # bucket, tail, id, text: the last one waits for its successor
        print_of_first = None
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, print_of_first, size
            pairs = [(a, b) for a, b in zip(held, held[1:]) if a[0] == b[0] and not a[1]]
            edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
            known = 1 if print_of_first is not None else 0
            prints = fingerprints_of([r[3] for r in held[known:]] + edited)
            own = [print_of_first] * known + prints[: len(held) - known]
            changed = prints[len(held) - known :]
            at = [k for k, (a, b) in enumerate(zip(held, held[1:])) if a[0] == b[0] and not a[1]]
            rows = list(zip(at, edited, changed))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([held[k][2] for k in at], id_type),
                    pa.array([len(held[k][3]) for k in at], pa.int64()),
                    pa.array(edited, pa.string()),
                    pa.array([own[k].tobytes().hex() for k in at], pa.string()),
                    pa.array([c.tobytes().hex() for c in changed], pa.string()),
                    pa.array([likeness(own[k], c) for k, _, c in rows], pa.float64()),
                    pa.array([likeness(own[k], own[k + 1]) for k in at], pa.float64()),
                ],
                names=[id_col, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            held, print_of_first, size = held[-1:], own[-1], len(held[-1][3])
            return out

        for batch in batches:
            id_type = batch.column("id").type
            for bucket, tail, i, packed in zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "id", "text"))):
                if tail and held and held[-1][0] == bucket and held[-1][1]:
                    continue  # a repeated row is the bound
                text = opener.decompress(packed).decode() if packed else ""
                held.append((bucket, tail, i, text))
                size += len(text)
                if size >= PACK_CHARS:
                    yield close()
        if len(held) > 1:
            yield close()

    schema = f"`{id_col}` {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return _dealt(docs).mapInArrow(work, schema)


# -- near copies -----------------------------------------------------------------------------------


def band_width(least: float) -> int:
    """Samples of a band, so that texts of likeness ``least`` or more always share one.

    Such texts differ in less than one of so many taken samples. A band is spoilt by a sample that differs, and
    there are at least as many bands with a taken sample as taken samples over the width: one is left.
    """
    if least <= 0:
        raise ValueError("texts are linked from a likeness above 0 on")
    apart = (1 - _CHANCE) * (1 - least / (2 - least))
    return SAMPLES if apart <= 1 / SAMPLES else max(1, math.ceil(1 / apart - 1e-9) - 1)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``likeness`` of the fingerprints in the rows of ``a`` and ``b``."""
    taken = ((a > 0) | (b > 0)).sum(axis=1)
    share = ((a == b) & (a > 0)).sum(axis=1) / np.maximum(taken, 1)
    common = np.maximum(0.0, (share - _CHANCE) / (1 - _CHANCE))
    return np.where(taken == 0, 1.0, 2 * common / (1 + common))


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SAMPLES)


def _linked(edges: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """The ``edges`` whose fingerprints are alike."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = alike(_prints(batch.column("fu")), _prints(batch.column("fv"))) >= least
            yield batch.select(["u", "v"]).filter(pa.array(keep))

    left, right = (entries.select(F.col("u").alias(k), F.col("print").alias(f"f{k}")) for k in ("u", "v"))
    return edges.join(left, "u").join(right, "v").select("u", "v", "fu", "fv").mapInArrow(work, "u long, v long")


def _across(members: DataFrame, entries: DataFrame, least: float) -> DataFrame:
    """Links ``u, v`` between classes: entries of one cell (``cell, u, comp, n``) that are alike, of different ``comp``.

    All entries of a cell are compared with those of other classes, in pairs of blocks where there are
    many; classes that a link has joined are one from there on.
    """

    def joined(prints: np.ndarray, comps: list) -> Iterator[tuple[int, int]]:
        names, class_of = np.unique(np.array(comps, np.int64), return_inverse=True)
        for k in range(len(comps) - 1):
            others = k + 1 + np.flatnonzero(class_of[k + 1 :] != class_of[k])
            for lo in range(0, len(others), COMPARED):
                some = others[lo : lo + COMPARED]
                hits = some[alike(prints[k : k + 1], prints[some]) >= least]
                for j in hits:
                    if class_of[j] != class_of[k]:
                        yield int(names[class_of[k]]), int(names[class_of[j]])
                        class_of[class_of == class_of[j]] = class_of[k]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, prints, comps, found = None, [], [], []

        def close() -> None:
            if len(prints) > 1:
                found.extend(joined(np.frombuffer(b"".join(prints), np.uint8).reshape(-1, SAMPLES), comps))

        def out() -> pa.RecordBatch:
            pairs = list(dict.fromkeys(found))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            for *at, comp, row in zip(*(c.to_pylist() for c in batch.columns)):
                if at != group:
                    close()
                    group, prints, comps = at, [], []
                prints.append(row)
                comps.append(comp)
            yield out()
        close()
        yield out()

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own, last = F.pmod(F.xxhash64("u", F.lit(3)), blocks).cast("int"), blocks - 1
    dealt = members.withColumn("own", own).withColumn(
        "other", F.explode(F.when(last == 0, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), last), F.col("own"))))
    )
    dealt = dealt.select("u", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "comp")
    dealt = dealt.join(entries.select("u", "print"), "u").select("cell", "i", "j", "comp", "print")
    return dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(work, "u long, v long")


def near_copies(prints: DataFrame, least: float = 0.8, id_col: str = "doc_id") -> DataFrame:
    """``prints`` with ``class_id``: the smallest id among the documents linked by fingerprints of likeness ``least`` or more.

    Equal fingerprints are one entry. Fingerprints are cut into bands so narrow that alike ones share a band
    (``band_width``), hence a cell. The entries of a cell are compared with its smallest one first; where that
    leaves a cell with several classes, their entries are compared with each other, so no link between classes
    is left out. ``class_id`` is null where no document of a class has an id. A ``fingerprint`` is bytes or their
    hexadecimal digits; it moves as bytes. Entries lie in buckets, so that joins do not move them again.
    """
    spark = prints.sparkSession
    prepare(spark)
    docs = without(prints, "class_id")
    digits = dict(docs.dtypes)["fingerprint"] == "string"
    if digits:
        docs = docs.withColumn("fingerprint", F.unhex("fingerprint"))
    docs = docs.withColumn("__u", F.xxhash64("fingerprint", F.lit(1)))
    entries = docs.groupBy(F.col("__u").alias("u")).agg(F.first("fingerprint").alias("print"), F.min(f"`{id_col}`").alias("low"))
    entries = written_in_buckets(entries, "u", int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    width = band_width(least)
    band = [F.substring("print", 1 + at, min(width, SAMPLES - at)) for at in range(0, SAMPLES, width)]
    empty = [F.lit(bytes(min(width, SAMPLES - at))) for at in range(0, SAMPLES, width)]
    cells = F.array(*[F.when(b != e, F.shiftrightunsigned(F.xxhash64(F.lit(k), b), 64 - CELL_BITS)) for k, (b, e) in enumerate(zip(band, empty, strict=True))])
    cells = entries.select("u", F.explode(F.array_compact(cells)).alias("cell"))
    whole = Window.partitionBy("cell")
    cells = cells.withColumn("v", F.min("u").over(whole)).withColumn("n", F.count(F.lit(1)).over(whole))
    cells = written(cells.filter("n > 1"))
    edges = cells.filter("u <> v").select("u", "v").distinct()
    first = connected_components(written(_linked(edges, entries, least)))

    # classes so far; cells with several of them, whose smallest entry may be alike to neither
    known = cells.filter("n > 2").join(first.select(F.col("node").alias("u"), "comp"), "u", "left").withColumn("comp", F.coalesce("comp", "u"))
    known = written(known.select("cell", "u", "comp", "n"))
    several = known.groupBy("cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b").select("cell")
    more = connected_components(written(_across(known.join(several, "cell", "left_semi"), entries, least)))

    named = entries.select("u", "low").join(first.select(F.col("node").alias("u"), "comp"), "u", "left")
    named = named.withColumn("comp", F.coalesce("comp", "u")).join(more.select(F.col("node").alias("comp"), F.col("comp").alias("joined")), "comp", "left")
    named = written(named.select("u", "low", F.coalesce("joined", "comp").alias("comp")))
    lows = named.groupBy("comp").agg(F.min("low").alias("class_id"))
    named = written(named.join(lows, "comp").select(F.col("u").alias("__u"), "class_id"))
    found = docs.join(named, "__u").drop("__u")
    return found.withColumn("fingerprint", F.lower(F.hex("fingerprint"))) if digits else found


def fingerprint_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``edited_fingerprints`` with the hash of the edited text in place of it, and ``near_copies`` of all documents."""
    found = edited_fingerprints(df, id_col, text_col).withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    found = written(found.withColumns({c: F.unhex(c) for c in DIGITS}))
    return near_copies(found, id_col=id_col).withColumns({c: F.lower(F.hex(c)) for c in DIGITS})
