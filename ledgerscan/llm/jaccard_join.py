"""N-gram Jaccard self-join by a size-aware heavy-light scheme, and its components.

Light sets (few shingles) list all their subsets of a fixed size: for sets of sizes a and b the size is
the overlap they need, so two sets that share a listed subset are linked, without looking further.
Heavy sets go through inverted lists. The boundary between both is the size up to which listing costs
less than scanning, computed from the counts of sizes.

The lists of heavy sets are keyed by pieces: the shingles of a set are dealt by their hash into one
piece more than two linked sets can differ in, so linked sets have a piece in common (lists of single
shingles would hold every document with a frequent phrase). Sets of one list whose sketches allow a
link form a candidate cluster: a sketch has a bit for every class of shingles, the parity of their
number, so two sets differ in as many shingles at least as their sketches in bits, and no link is lost.
Clusters are compared exactly, in blocks of bounded size, around pivots: what is linked to a
pivot needs no comparison among itself, and the triangle inequality of the Jaccard distance leaves out
most of the rest. A block gives a spanning forest, never all pairs. Equal sets are one set from the start.

Shingles are compared by 64-bit hashes. Links are ``100 * both >= percent * either``.

Cases: a null or empty text, or one of white space, has no shingles and is linked with nothing; with
fewer words than a shingle takes, all words are one shingle; rows that share a ``doc_id`` are kept;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerscan.llm.common import Memory, prepare, text_of, written
from ledgerscan.llm.components import connected_components

#: Sets up to this size may be light; their shingles travel with the row.
LIGHT_MOST = 40
#: Shingles in a block of a cluster.
BLOCK_SHINGLES = 1 << 20
#: Bytes of text a shingle up to which a set is sent as its text; bounds the texts of a block.
SHINGLE_TEXT = 16
#: Rows of two longs up to this number are broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 2_000_000
KNOWN_WORDS = 200_000
#: From this number of pieces on, empty ones are not listed. A link would be lost only if fewer than m
#: differences hit every piece that is not empty: about sqrt(2 pi m) exp(-m), below 2e-13, less than
#: what hashing shingles to 64 bits leaves open.
MANY_PIECES = 32
#: Below it, a set with empty pieces is dealt again by another hash, until none is empty. Two linked sets
#: that agree in empty pieces only are both dealt again, so no link is lost; the last level lists all.
LEVELS = 64

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64 bits."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


# -- sizes ---------------------------------------------------------------------------------------


def needed(a: int, b: int, percent: int) -> int:
    """The smallest overlap that links sets of sizes ``a`` and ``b``."""
    return -(-percent * (a + b) // (100 + percent))


def size_classes(percent: int, most: int = 1 << 40) -> list[int]:
    """First size of every class: a linked larger set is in the same class or the next."""
    out = [1]
    while out[-1] < most:
        out.append(out[-1] * 100 // percent + 1)
    return out


def pieces(classes: list[int], k: int, percent: int) -> int:
    """One more than the shingles in which linked sets, the smaller of class ``k``, can differ."""
    small = classes[k + 1] - 1
    return 1 + (small + small * 100 // percent) * (100 - percent) // (100 + percent)


def partners(a: int, percent: int, most: int) -> list[int]:
    """Sizes up to ``most`` a set of size ``a`` can be linked with."""
    return [b for b in range(-(-a * percent // 100), min(most, a * 100 // percent) + 1) if b > 0]


def listing_cost(a: int, percent: int, most: int) -> int:
    return sum(math.comb(a, needed(a, b, percent)) for b in partners(a, percent, most))


def boundary(sizes: dict[int, int], percent: int, most: int = LIGHT_MOST) -> int:
    """Largest light size: up to it, listing subsets costs less than pieces and one comparison."""
    classes, best, gain, total = size_classes(percent, most * 2), 0, 0, 0
    for a in range(1, most + 1):
        k = next(i for i in range(len(classes) - 1) if classes[i] <= a < classes[i + 1])
        scan = pieces(classes, k, percent) + (pieces(classes, k - 1, percent) if k else 0) + a
        total += sizes.get(a, 0) * (scan - listing_cost(a, percent, a))
        if total >= gain:
            best, gain = a, total
    return best


# -- sets ----------------------------------------------------------------------------------------


class Shingler:
    def __init__(self, words: int):
        self.words = words
        self.known = Memory(xxhash.xxh3_64_intdigest, KNOWN_WORDS)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes; words are bytes between white space, A-Z in lower case."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        hashes = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        size = min(self.words, len(words))
        out = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            out = mix(out * _C + hashes[k : len(words) - size + 1 + k])
        return np.unique(out)


@functools.cache
def shingler(words: int) -> Shingler:
    """The one of a worker, so that its memory of words lasts."""
    return Shingler(words)


def class_of(n: int, classes: list[int]) -> int:
    return int(np.searchsorted(classes, n, side="right")) - 1


def signatures(shingles: np.ndarray, classes: list[int], percent: int) -> list[np.ndarray]:
    """Piece hashes of a set: as the smaller set (its own class) and as the larger (the class below)."""
    own = class_of(len(shingles), classes)
    spread = mix(shingles)
    both = []
    for k in (own, own - 1):
        out = []
        both.append(out)
        if k < 0:
            continue
        m = pieces(classes, k, percent)
        for level in range(LEVELS):
            dealt = shingles >> np.uint64(20) if level == 0 else mix(shingles + np.uint64(level * int(_B) % (1 << 64)))
            piece = (dealt % np.uint64(m)).astype(np.int64)
            sums = np.zeros(m, np.uint64)
            np.add.at(sums, piece, spread)
            keys = mix(sums + np.arange(m, dtype=np.uint64) * _A + np.uint64((k + (level << 12)) * int(_B) % (1 << 64)))
            used = np.bincount(piece, minlength=m) > 0
            out.append(keys[used] if level + 1 < LEVELS else keys)
            if m >= MANY_PIECES or used.all():
                break
    return [np.concatenate(out) if out else np.zeros(0, np.uint64) for out in both]


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the number of shingles by hash, one bit a shingle at least; a power of two bits, 64 or more."""
    bits = 64 << max(0, (len(shingles) - 1).bit_length() - 6)
    odd = np.bincount((mix(shingles) >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """A sketch of ``n`` words out of one of more: bits of places that are equal in the shorter one are added."""
    return np.bitwise_xor.reduce(words.reshape(-1, n), axis=0)


def near_sketches(sketches: list[np.ndarray], sizes: np.ndarray, own: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs, one of them ``own`` at least, whose sketches allow a link."""
    n = min(map(len, sketches))
    words = np.stack([folded(s, n) for s in sketches])
    left, edges = np.arange(len(sizes)), []
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            p = reached.pop()
            total = sizes[left] + sizes[p]
            most = total - 2 * -(-percent * total // (100 + percent))  # shingles in which linked sets can differ
            least = np.maximum(np.bitwise_count(words[left] ^ words[p]).sum(axis=1, dtype=np.int64), abs(sizes[left] - sizes[p]))
            hit = (least <= most) & (own[left] | own[p])
            found, left = left[hit], left[~hit]
            edges += [(int(p), int(x)) for x in found]
            reached += found.tolist()
    return edges


def set_table(docs: DataFrame, percent: int, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: ``doc_id, th`` (text hash), ``n, cid, k`` (set and its size class), ``pieces``, ``below``
    (of its own class and the one below), ``small``, ``sketch``; written."""
    prepare(docs.sparkSession)
    classes = size_classes(percent)

    def run(batches):
        shingler = Shingler(shingle_words)
        for batch in batches:
            n, cid, cls, sig, below, small, sketches = [], [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingler.shingles(text)
                n.append(len(s))
                if not len(s):
                    cid.append(None), cls.append(None), sig.append(None), below.append(None), small.append(None), sketches.append(None)
                    continue
                cid.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                cls.append(class_of(len(s), classes))
                for found, into in zip(signatures(s, classes, percent), (sig, below), strict=True):
                    into.append(found.view(np.int64))
                small.append(s.view(np.int64) if len(s) <= LIGHT_MOST else None)
                sketches.append(sketch(s).tobytes())
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cid, pa.int64()), pa.array(cls, pa.int32())]
                + [*(pa.array(x, kind) for x in (sig, below, small)), pa.array(sketches, pa.binary())],
                ["doc_id", "th", "n", "cid", "k", "pieces", "below", "small", "sketch"],
            )

    text = text_of(text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))
    kinds = "doc_id long, th long, n long, cid long, k int, pieces array<long>, below array<long>, small array<long>, sketch binary"
    made = rows.mapInArrow(run, kinds)
    return written(made.withColumn("row", F.monotonically_increasing_id()))


def light_links(light: DataFrame, most: int, percent: int) -> DataFrame:
    """Links of light sets (``cid, n, small``) through shared subsets."""

    def subsets(batches):
        for batch in batches:
            cids, sizes, lo, hi, key = [], [], [], [], []
            for row in batch.to_pylist():
                a = row["n"]
                s = mix(np.array(row["small"], np.int64).view(np.uint64))
                whole = s.sum(dtype=np.uint64)
                for b in partners(a, percent, most):
                    gone = a - needed(a, b, percent)
                    if gone < 0:
                        continue
                    drop = np.array([*itertools.combinations(range(a), gone)], np.int64).reshape(math.comb(a, gone), gone)
                    keys = whole - s[drop].sum(axis=1, dtype=np.uint64)
                    cids += [row["cid"]] * len(keys)
                    sizes += [a] * len(keys)
                    lo += [min(a, b)] * len(keys)
                    hi += [max(a, b)] * len(keys)
                    key += keys.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (cids, sizes, lo, hi, key)], ["cid", "n", "lo", "hi", "key"]
            )

    rows = light.mapInArrow(subsets, "cid long, n long, lo long, hi long, key long")
    # sets of the smaller size are linked with all sets of their subset; one of them stands for all
    group = Window.partitionBy("lo", "hi", "key")
    led = rows.withColumn("u", F.min(F.when(F.col("n") == F.col("lo"), F.col("cid"))).over(group))
    return led.filter("u is not null and u <> cid").select("u", F.col("cid").alias("v")).distinct()


def local_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``, by pivots (see the module).

    A pivot is compared with the sets that share one of its rarest shingles: whatever is linked to it,
    or to a set linked to it, overlaps it by ``2 * percent - 100`` and so has one of them in common.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    vocabulary, flat, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    mark = np.zeros(len(vocabulary), bool)
    parent = [*range(m)]
    alive = np.ones(m, bool)

    # inverted lists of the rarest shingles of every set
    low = max(0, 2 * percent - 100)
    owner = np.repeat(np.arange(m), sizes)
    rare = np.lexsort((flat, times[flat], owner))
    rare = rare[np.arange(len(flat)) - np.repeat(starts, sizes) < np.repeat(sizes + (-low * sizes // 100) + 1, sizes)]
    rare = rare[times[flat[rare]] > 1]
    tokens, owners = flat[rare], owner[rare]
    listed = owners[np.argsort(tokens, kind="stable")]
    many = np.bincount(tokens, minlength=len(vocabulary))
    begin = np.cumsum(many) - many
    own = np.searchsorted(owners, np.arange(m + 1))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def stretches(first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Places ``first, first + 1, ...`` of every stretch."""
        return np.repeat(first - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())

    def candidates(p: int) -> np.ndarray:
        t = tokens[own[p] : own[p + 1]]
        found = listed[stretches(begin[t], many[t])]
        return np.unique(found[alive[found]])

    def shared(p: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the overlaps of ``p`` with ``others``."""
        mark[flat[starts[p] : starts[p] + sizes[p]]] = True
        lengths = sizes[others]
        at = stretches(starts[others], lengths)
        sums = np.add.reduceat(mark[flat[at]].astype(np.int64), np.cumsum(lengths) - lengths)
        mark[flat[starts[p] : starts[p] + sizes[p]]] = False
        return sums

    links = []
    for p in range(m):
        if not alive[p]:
            continue
        alive[p] = False
        others = candidates(p)
        if not len(others):
            continue
        both = shared(p, others)
        either = sizes[p] + sizes[others] - both
        linked = 100 * both >= percent * either
        far = 1 - both / either
        for y in others[linked]:
            if find(p) != find(y):
                parent[find(y)] = find(p)
                links.append((p, y))
        near, limit = others[linked], 1 - percent / 100
        near_far = far[linked]
        alive[near] = False
        for x, d in zip(others[~linked], far[~linked], strict=True):
            if d <= 2 * limit + 1e-9 and find(x) != find(p):
                ys = near[near_far >= d - limit - 1e-9]
                for lo in range(0, len(ys), 256):
                    some = ys[lo : lo + 256]
                    b = shared(x, some)
                    hit = np.flatnonzero(100 * b >= percent * (sizes[x] + sizes[some] - b))
                    if len(hit):
                        y = some[hit[0]]
                        parent[find(x)] = find(y)
                        links.append((y, x))
                        break
    return links


def allowed(stars: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` that sketches allow within each of ``stars``: lists ``star`` of ``node, n, own, sketch``."""

    def run(batches):
        for batch in batches:
            stars = batch.column(0)
            nodes, sizes, own = (stars.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "own"))
            sketches = [np.frombuffer(s.as_buffer(), np.uint64) for s in stars.flatten().field("sketch")]
            ends = np.cumsum(stars.value_lengths().to_numpy())
            u, v = [], []
            for lo, hi in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
                for a, b in near_sketches(sketches[lo:hi], sizes[lo:hi], own[lo:hi], percent):
                    u.append(min(nodes[lo + a], nodes[lo + b])), v.append(max(nodes[lo + a], nodes[lo + b]))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return stars.select("star").mapInArrow(run, "u long, v long")


def heavy_links(
    docs: DataFrame, sets: DataFrame, reps: DataFrame, percent: int, shingle_words: int, id_col: str, text_col: str
) -> DataFrame:
    """Links of the sets in ``reps`` (``row, cid, n, th, doc_id, pieces, below, sketch``) through inverted lists and comparison in blocks.

    Clusters are formed class by class: a set is a member (``node``) of its own class and, as the larger set, of the
    class below. In one graph sets of all sizes would hang together by chance and go to blocks they cannot be linked in.
    Long sets of one class share pieces by chance too, each with a share of all others: only links that the sketches
    allow are followed, or clusters and blocks a set would grow with the corpus.
    """
    # numbers of rows are packed better than hashes; the last bit tells the set's own class from the one below
    node = {"pieces": F.col("row") * 2 + 1, "below": F.col("row") * 2}
    own = F.col("node").bitwiseAND(1) == 1
    lists = [reps.select(at.alias("node"), F.explode(c).alias("piece")) for c, at in node.items()]
    group = Window.partitionBy("piece")
    # lists of larger sets only say nothing that those of their own class do not
    led = lists[0].unionByName(lists[1]).withColumns({"u": F.min("node").over(group), "some": F.max(own).over(group)})
    # sets of one list are all in the star of its leader
    stars = led.filter("some and u <> node").select("u", F.explode(F.array("u", "node")).alias("node")).distinct()
    known = reps.select(F.explode(F.array(*node.values())).alias("at"), "n", "sketch")
    stars = stars.join(known, F.col("node") == F.col("at"))
    stars = stars.groupBy("u").agg(F.collect_list(F.struct("node", "n", own.alias("own"), "sketch")).alias("star"))
    # a set hangs on the smallest of its leaders, and so do its other leaders: as connected, with far fewer edges
    hung = allowed(stars, percent).distinct()
    hung = hung.withColumn("m", F.min("u").over(Window.partitionBy("v")))
    candidates = hung.select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter("u <> v").distinct()
    cluster = connected_components(candidates)
    places = reps.select("cid", "n", "th", "doc_id", F.explode(F.array(*node.values())).alias("at"))
    members = places.join(cluster, F.col("at") == F.col("node")).select("cid", "n", "th", "doc_id", "comp")
    blocks = members.groupBy("comp").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    members = members.join(blocks, "comp").groupBy("cid", "n", "th", "doc_id").agg(F.collect_list(F.struct("comp", "blocks")).alias("at"))  # two at most
    members = written(members)
    wanted = members.select(F.col("th").alias("wanted"), F.col("doc_id").alias("of"), "cid", "n", "at")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    named = (F.col("th") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("of"))
    text = text_of(text_col)
    rows = docs.select(F.xxhash64(text).alias("th"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.join(wanted, named).select("cid", "n", "at", "text")
    # id and text name one row, unless rows are equal in both: only then texts are grouped, which moves all of them once more
    if not sets.select("th", "doc_id").join(wanted, named).groupBy("cid").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("cid").agg(*(F.first(c).alias(c) for c in ("n", "at", "text")))
    # a set for several blocks goes as shingles; one for a single block as its text, packed half of them, unless far longer
    single = F.forall("at", lambda place: place["blocks"] == 1) & (F.octet_length("text") <= SHINGLE_TEXT * F.col("n"))

    def shingle(batches):
        for batch in batches:
            texts, alone = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found = [None if a else shingler(shingle_words).shingles(t).tobytes() for a, t in zip(alone, texts, strict=True)]
            texts = [t if a else None for a, t in zip(alone, texts, strict=True)]
            made = [pa.array(texts, batch.column(2).type), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], ["cid", "at", "text", "s"])

    rows = rows.select("cid", "at", "text", single.alias("single"))
    made = rows.mapInArrow(shingle, "cid long, at array<struct<comp: long, blocks: int>>, text string, s binary")
    made = made.select("cid", "text", "s", F.inline("at"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    last = F.col("blocks") - 1
    other = F.explode(F.when(last == 0, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), last), F.col("own"))))
    dealt = made.withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("cid", "comp", "text", "s", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        cids, texts, made = (table.column(c).to_pylist() for c in ("cid", "text", "s"))
        sets = [shingler(shingle_words).shingles(t) if s is None else np.frombuffer(s, np.uint64) for t, s in zip(texts, made, strict=True)]
        found = local_links(sets, percent)
        return pa.table({"u": pa.array([cids[a] for a, _ in found], pa.int64()), "v": pa.array([cids[b] for _, b in found], pa.int64())})

    return dealt.groupBy("comp", "i", "j").applyInArrow(compare, "u long, v long")


def linked_components(
    docs: DataFrame, percent: int = 80, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row: the smallest ``doc_id`` reachable by links."""
    sets = set_table(docs, percent, shingle_words, id_col, text_col)
    copies = sets.filter("n > 0").groupBy("cid").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("rows"))
    copies = written(copies.filter("rows > 1").select(F.col("cid").alias("copied"), "rep"))
    copied = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    reps = sets.filter("n > 0").join(copied, F.col("cid") == F.col("copied"), "left").filter("rep is null or rep = row")

    sizes = reps.filter(F.col("n") <= LIGHT_MOST).groupBy("n").count().collect()  # at most LIGHT_MOST rows
    most = boundary({r["n"]: r["count"] for r in sizes}, percent)
    light = light_links(reps.filter(F.col("n") <= most).select("cid", "n", "small"), most, percent)
    # a light set can be linked with a heavy one only if it is nearly as large
    heavy = reps.filter(F.col("n") * 100 >= percent * (most + 1)).select("row", "cid", "n", "th", "doc_id", "pieces", "below", "sketch")
    links = light.unionByName(heavy_links(docs, sets, heavy, percent, shingle_words, id_col, text_col))
    groups = connected_components(links)
    named = sets.select("doc_id", "n", "cid").join(groups, F.col("cid") == F.col("node"), "left")
    named = named.select("doc_id", "n", F.coalesce("comp", "cid").alias("comp"))
    first = named.filter("comp is not null").groupBy(F.col("comp").alias("c")).agg(F.min("doc_id").alias("first"))
    return named.join(first, F.col("comp") == F.col("c"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id")
    )
