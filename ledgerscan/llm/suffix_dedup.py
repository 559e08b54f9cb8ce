"""Removal of long repeated byte strings by hash-compared suffix sorting.

1. Every window of ``LENGTH`` bytes is given an anchor, the ``ANCHOR``-byte string in it with the smallest
   hash, so equal windows have equal anchors at equal places. Anchors found more than once are kept.
2. Around such anchors the bytes that a window with this anchor can reach are a context. Equal contexts
   are one from here on.
3. The contexts of an anchor are compared in one task: suffixes are merge-sorted, two suffixes are
   compared by binary search for the length of their common prefix with prefix polynomial hashes, and
   neighbours in the order that agree over the whole length are compared byte by byte, so a collision
   of hashes changes nothing. A range of window places is settled at once where the string over the
   whole range repeats, dropped where not even the bytes common to all its windows repeat, and halved
   otherwise.
4. Every text is read again and loses the bytes of its repeated windows. A text that occurs twice as a
   whole needs no comparison.

``LENGTH`` counts bytes of UTF-8; matches never cross rows, and are judged on the input.

Cases: a null or empty text and texts shorter than ``LENGTH`` lose nothing; equal rows longer than that
lose everything; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscan.llm.common import prepare, text_of, written

LENGTH = 400
ANCHOR = 64
#: Anchors are chosen in stretches of a text, so that places fit into 24 bits.
STRETCH = 1 << 23
#: Bytes of contexts that a task compares at once (an anchor is never split).
BATCH_BYTES = 4 << 20
#: Rows of short keys up to this number are broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 500_000

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@cache
def _first_powers(base: int) -> np.ndarray:
    return _powers(base, 1 << 16)


def powers(base: int, count: int) -> np.ndarray:
    """``base`` to the power of 0 to ``count`` - 1; the first 65,536 are kept."""
    return _first_powers(base)[:count] if count <= 1 << 16 else _powers(base, count)


class PrefixHash:
    """Hashes of any stretch of bytes by differences; places count from ``origin`` of each row of bytes."""

    def __init__(self, data: np.ndarray, origin: np.ndarray | None = None):
        place = np.arange(len(data)) if origin is None else np.arange(len(data)) - origin
        most = int(place.max()) + 2 if len(place) else 2
        self.place = place
        self.inverse = powers(_INVERSE, most)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, most)[place], out=self.sums[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[self.place[np.minimum(start, len(self.place) - 1)]]


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(data: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of all windows, in ascending order of place."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    width = length - anchor + 1
    for lo in range(0, max(0, len(data) - length + 1), STRETCH):
        part = data[lo : lo + STRETCH + length - 1]
        if len(part) < length:
            break
        count = len(part) - anchor + 1
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(part)), out=sums[1:])
        h = spread((sums[anchor:] - sums[:-anchor]) * powers(_INVERSE, count))
        key = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(count, dtype=np.uint64)
        padded = np.full(-(-count // width) * width, np.iinfo(np.uint64).max, np.uint64)
        padded[:count] = key
        rows = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = count - width + 1
        least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)  # the least of a sliding window only moves forward
        at = at[np.append(True, at[1:] != at[:-1])]
        places.append(at + lo)
        hashes.append(h[at])
    if len(places) <= 2:
        return places[-1], hashes[-1]
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


class Suffixes:
    """Equal strings among suffixes of a text, through their sorted order."""

    def __init__(self, data: np.ndarray, origin: np.ndarray):
        self.data = data
        self.hash = PrefixHash(data, origin)

    def common(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes, up to ``length``: binary search over hashes."""
        out = length.copy()
        differ = np.flatnonzero(self.hash.of(a, length) != self.hash.of(b, length))
        if len(differ):
            a, b = a[differ], b[differ]
            lo, hi = np.zeros(len(a), np.int64), length[differ] - 1  # common prefix in lo..hi
            while (lo < hi).any():
                mid = (lo + hi + 1) >> 1
                same = self.hash.of(a, mid) == self.hash.of(b, mid)
                lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
            out[differ] = lo
        return out

    def less(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether suffix ``a`` sorts before ``b`` within ``length``."""
        n = self.common(a, b, length)
        inside = np.minimum(n, length - 1)
        return (n < length) & (self.data[a + inside] < self.data[b + inside])

    def order(self, start: np.ndarray, length: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Places of the suffixes, sorted within segments: a bottom-up merge sort of all segments at once."""
        order = np.argsort(segment, kind="stable")
        seg = segment[order]
        n = len(order)
        first = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        sizes = np.diff(np.append(first, n))
        origin = np.repeat(first, sizes)
        end = origin + np.repeat(sizes, sizes)
        width = 1
        while width < sizes.max(initial=1):
            at = np.arange(n)
            inside = at - origin
            run = inside // width
            other_lo = np.where(run % 2 == 0, origin + (run + 1) * width, origin + (run - 1) * width)
            other_hi = np.minimum(other_lo + width, end)
            other_lo = np.minimum(other_lo, end)
            # place in the other run: left rows count smaller ones, right rows count those not larger
            lo, hi = other_lo.copy(), np.maximum(other_hi, other_lo)
            while True:
                open_ = np.flatnonzero(lo < hi)
                if not len(open_):
                    break
                mid = (lo[open_] + hi[open_]) >> 1
                mine, theirs = order[open_], order[mid]
                left = run[open_] % 2 == 0
                a, b = np.where(left, theirs, mine), np.where(left, mine, theirs)
                before = self.less(start[a], start[b], length[mine])  # theirs < mine, or mine < theirs
                right = np.where(left, before, ~before)
                lo[open_] = np.where(right, mid + 1, lo[open_])
                hi[open_] = np.where(right, hi[open_], mid)
            base = origin + (run // 2) * 2 * width
            target = base + (inside - run * width) + (lo - other_lo)
            merged = np.empty_like(order)
            merged[target] = order
            order = merged
            width *= 2
        return order

    def classes(self, start: np.ndarray, length: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """A class per suffix: equal strings of one segment share it; checked byte by byte."""
        if not len(start):
            return np.zeros(0, np.int64)
        out = np.arange(len(start))
        # a string whose hash no other string of its segment has is equal to none: only the others are sorted
        hashes = self.hash.of(start, length)
        by = np.lexsort((hashes, segment))
        same = (hashes[by][1:] == hashes[by][:-1]) & (segment[by][1:] == segment[by][:-1])
        shared = np.sort(by[np.append(False, same) | np.append(same, False)])
        start, length, segment = start[shared], length[shared], segment[shared]
        order = self.order(start, length, segment)
        a, b = order[:-1], order[1:]
        near = np.flatnonzero(segment[a] == segment[b])
        near = near[hashes[shared][a[near]] == hashes[shared][b[near]]]
        equal = np.zeros(len(order), bool)
        # neighbours of one segment have one length; a segment is a range of places, so there are few lengths
        sizes = length[a[near]]
        for size in np.unique(sizes).tolist():
            strings, pairs = np.lib.stride_tricks.sliding_window_view(self.data, size), near[sizes == size]
            for lo in range(0, len(pairs), 4096):
                some = pairs[lo : lo + 4096]
                equal[some + 1] = (strings[start[a[some]]] == strings[start[b[some]]]).all(axis=1)
        if len(order):
            first = np.flatnonzero(~equal)
            out[shared[order]] = np.repeat(shared[order[first]], np.diff(np.append(first, len(order))))
        return np.unique(out, return_inverse=True)[1]


def repeated_places(contexts: list[bytes], left: np.ndarray, group: np.ndarray, many: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
    """For every context the ranges of window places (bytes before the anchor) that repeat.

    Returns arrays ``context, lo, hi``. ``many`` marks contexts that stand for several.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contexts), np.uint8)
    suffixes = Suffixes(data, np.repeat(begin, sizes))
    at = begin + left
    top = length - anchor
    least, most = np.maximum(0, top - (sizes - left - anchor)), np.minimum(left, top)
    known = np.flatnonzero(many & (least <= most))
    found = [(known, least[known], most[known])]
    x, lo, hi = np.arange(len(contexts)), np.zeros(len(contexts), np.int64), np.full(len(contexts), top)
    settled = many.copy()
    while len(x):
        usable = (lo <= most[x]) & (hi >= least[x])
        x, lo, hi, settled = x[usable], lo[usable], hi[usable], settled[usable]
        segment = (group[x] * (top + 1) + lo) * (top + 1) + hi
        whole = (lo >= least[x]) & (hi <= most[x])
        w = np.flatnonzero(whole)
        classes = suffixes.classes(at[x[w]] - hi[w], length + hi[w] - lo[w], segment[w])
        keep = np.ones(len(x), bool)
        if len(w):
            count = np.bincount(classes)
            again = count[classes] > 1
            new = w[again & ~settled[w]]
            found.append((x[new], lo[new], hi[new]))
            settled[w[again]] = True
            # one of equal strings goes on, for others to be compared with
            _, one = np.unique(classes, return_index=True)
            keep[w] = False
            keep[w[one]] = True
        keep &= lo < hi
        x, lo, hi, settled, segment = x[keep], lo[keep], hi[keep], settled[keep], segment[keep]
        # bytes that all windows of the range have in common: over all places the anchor, which a group has in common
        if len(x) and lo[0] == 0 and hi[0] == top:
            classes = np.unique(segment, return_inverse=True)[1]
        else:
            classes = suffixes.classes(at[x] - lo, length - (hi - lo), segment)
        if len(x):
            count = np.bincount(classes)
            open_ = np.bincount(classes, weights=~settled)
            keep = (count[classes] > 1) & (open_[classes] > 0)
            x, lo, hi, settled = x[keep], lo[keep], hi[keep], settled[keep]
        mid = (lo + hi) >> 1
        x, settled = np.concatenate([x, x]), np.concatenate([settled, settled])
        lo, hi = np.concatenate([lo, mid + 1]), np.concatenate([mid, hi])
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def merged(starts: list[int], ends: list[int]) -> tuple[list[int], list[int]]:
    """Maximal runs of overlapping or touching spans."""
    lo, hi = [], []
    for a, b in sorted(zip(starts, ends, strict=True)):
        if hi and a <= hi[-1]:
            hi[-1] = max(hi[-1], b)
        else:
            lo.append(a), hi.append(b)
    return lo, hi


def _semi(rows: DataFrame, keys: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """``rows`` with their key among ``keys``; few keys are broadcast."""
    small = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return rows.join(small, column, how)


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``key, lo, hi``: removed byte spans of every distinct text of ``texts`` (``key, text``) that loses any; written."""
    prepare(texts.sparkSession)

    def first_pass(batches):
        for batch in batches:
            sizes, found = [], []
            for text in batch.column(1).to_pylist():
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                sizes.append(len(data))
                # an anchor found twice in a text is listed twice, and so counts as repeated
                values, times = np.unique(anchors(data)[1], return_counts=True)
                found.append(np.repeat(values, np.minimum(times, 2)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["key", "n", "anchors"])

    marked = written(
        texts.mapInArrow(first_pass, "key string, n long, anchors array<long>").filter(F.col("n") >= LENGTH)
        .withColumn("row", F.monotonically_increasing_id())
    )
    copies = marked.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("rep"), F.first("n").alias("n"))
    copies = written(copies.filter("rows > 1"))
    few = copies.count() <= BROADCAST_ROWS
    reps = copies.select(F.col("key").alias("copied"), "rep")
    reps = marked.join(F.broadcast(reps) if few else reps, F.col("key") == F.col("copied"), "left").filter("rep is null or rep = row")
    each = reps.select("key", F.explode("anchors").alias("h"))
    repeated = written(each.groupBy("h").count().filter("count > 1").select("h"))
    wanted = each.distinct().join(repeated, "h").groupBy("key").agg(F.collect_list("h").alias("hs"))
    wanted = written(wanted)

    # contexts of repeated anchors, each distinct text once
    ones = _semi(texts, wanted.select("key"), "key").groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")

    def contexts(batches):
        reach = LENGTH - ANCHOR
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        held, size = [[] for _ in kinds], 0

        def close():
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(held, kinds, strict=True)], ["key", "at", "h", "ck", "left", "context"])
            for v in held:
                v.clear()
            return out

        for batch in batches:
            for key, text, hs in zip(*[batch.column(c).to_pylist() for c in ("key", "text", "hs")], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                place, h = anchors(np.frombuffer(raw, np.uint8))
                place, h = (v[np.isin(h, np.array(hs, np.int64).view(np.uint64))] for v in (place, h))
                left = np.minimum(place, reach)
                cut = [raw[p - b : p + ANCHOR + reach] for p, b in zip(place.tolist(), left.tolist(), strict=True)]
                ck = [xxhash.xxh3_64_intdigest(c, seed=b) - (1 << 63) for c, b in zip(cut, left.tolist(), strict=True)]
                for v, new in zip(held, ([key] * len(cut), place.tolist(), h.view(np.int64).tolist(), ck, left.tolist(), cut), strict=True):
                    v += new
                size += sum(map(len, cut))
                if size >= BATCH_BYTES:
                    yield close()
                    size = 0
        yield close()

    seen = written(ones.mapInArrow(contexts, "key string, at long, h long, ck long, left long, context binary"))
    distinct = seen.groupBy("h", "ck").agg(
        F.count(F.lit(1)).alias("times"), F.first("left").alias("left"), F.first("context").alias("context")
    )
    dealt = distinct.repartition("h").sortWithinPartitions("h")

    def compare(batches):
        rows: list[tuple] = []
        held = 0

        def close(part):
            if not part:
                return
            hs = np.array([r[0] for r in part], np.int64)
            _, group = np.unique(hs, return_inverse=True)
            many = np.array([r[2] > 1 for r in part])
            k, lo, hi = repeated_places([r[4] for r in part], np.array([r[3] for r in part], np.int64), group.astype(np.int64), many)
            if len(k):
                cks = np.array([r[1] for r in part], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hs[k]), pa.array(cks[k]), pa.array(lo), pa.array(hi)], ["h", "ck", "lo", "hi"])

        for batch in batches:
            for r in zip(*[batch.column(c).to_pylist() for c in ("h", "ck", "times", "left", "context")], strict=True):
                if held >= BATCH_BYTES and r[0] != rows[-1][0]:
                    yield from close(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[4])
        yield from close(rows)

    verdict = dealt.mapInArrow(compare, "h long, ck long, lo long, hi long")
    spans = seen.select("key", "at", "h", "ck").join(verdict, ["h", "ck"])
    spans = spans.select("key", (F.col("at") - F.col("hi")).alias("lo"), (F.col("at") - F.col("lo") + LENGTH).alias("hi"))
    per_text = spans.groupBy("key").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))

    def join_up(batches):
        kind = pa.list_(pa.int64())
        for batch in batches:
            both = [merged(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in both], kind), pa.array([y for _, y in both], kind)], ["key", "lo", "hi"])

    per_text = per_text.mapInArrow(join_up, "key string, lo array<long>, hi array<long>")
    # a text that occurs twice goes as a whole
    whole = copies.select("key", F.array(F.lit(0).cast("long")).alias("lo"), F.array("n").alias("hi"))
    rest = _semi(per_text, copies.select("key"), "key", "left_anti")
    return written(rest.unionByName(whole))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes) of every row."""
    text = text_of(text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.sha2(text, 256).alias("key"), text.alias("text"))
    spans = repeated_spans(rows.select("key", "text"))
    size = spans.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("lo")).alias("spans")).first()
    small = size["n"] <= BROADCAST_ROWS and (size["spans"] or 0) <= 4 * BROADCAST_ROWS
    joined = rows.join(F.broadcast(spans) if small else spans, "key", "left").select("doc_id", "text", "lo", "hi")

    def cut(batches):
        for batch in batches:
            n, gone, count, kept = [], [], [], []
            for text, lo, hi in zip(*[batch.column(c).to_pylist() for c in ("text", "lo", "hi")], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                lo, hi = lo or [], hi or []
                out = b"".join(raw[a:b] for a, b in zip([0, *hi], [*lo, len(raw)], strict=True))
                n.append(len(raw)), gone.append(len(raw) - len(out)), count.append(len(lo)), kept.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, pa.int64()) for v in (n, gone, count)], pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``."""
    found = remove_repeats(docs)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
