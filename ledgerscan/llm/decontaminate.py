"""Benchmark decontamination by spaced seeds. DataFrame functions only.

A seed is a fixed mask over neighbouring words; words at its open places are ignored. The mask of an item
is the heaviest of ``MASKS`` that no substitutions within ``share`` of ``stretch`` item words (the whole
item if it is shorter) can hit at all of its places, so every overlap leaves a seed whole. Masked hashes
of all places of the benchmark items and of the documents are joined; around every hit the words of
document and item are compared place by place, and an overlap counts where ``share`` of a stretch is
equal.

Words are runs of letters and digits, in lower case, so punctuation plays no part.

Cases: null and empty texts and items without words have no hits; short items are found by lighter masks,
one of a word or two wherever its words stand; equal rows of documents each get their rows; items with
equal words are each reported; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from ledgerscan.llm.common import text_of, without, written

#: From the heaviest: a hash takes the words marked 1. The first serves 15 words and more at ``SHARE``.
MASKS = ("11101", "1111", "1101", "111", "11", "1")
STRETCH = 20
SHARE = 0.8
#: Seeds of the benchmark up to this number (24 bytes each) are broadcast; beyond, Spark joins by shuffle.
BROADCAST_SEEDS = 4_000_000
#: The same for digests of matching texts (under 100 bytes each).
BROADCAST_KEYS = 500_000
NOT_WORD = r"[^\p{L}\p{N}]+"


def plain_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda w: w != "")


def least_changes(mask: str, n: int) -> int:
    """The fewest substitutions in ``n`` words that hit ``mask`` at every place; 0 where it has no place."""
    span = len(mask)
    taken = int(mask, 2)
    costs = {0: 0}  # by the changed ones of the last words
    for k in range(1, n + 1):
        after: dict[int, int] = {}
        for last, cost in costs.items():
            for change in (0, 1):
                now = (last << 1 | change) & ((1 << span) - 1)
                if (k < span or now & taken) and cost + change < after.get(now, n + 1):
                    after[now] = cost + change
        costs = after
    return min(costs.values())


def mask_of(n: int, share: float) -> str:
    """The first mask that is left whole by all substitutions ``share`` allows in ``n`` words."""
    changes = n - next(k for k in range(n + 1) if k >= share * n)
    return next((m for m in MASKS if least_changes(m, n) > changes), MASKS[-1])


def seeds(hashes: str, masks: list[str]) -> Column:
    """``(place, hash)`` of the masks at every place of an array of word hashes."""

    def of(mask):
        last = F.size(hashes) - len(mask)
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("array()").cast("array<int>"))

        def at(p):
            words = [F.get(hashes, p + k) for k, bit in enumerate(mask) if bit == "1"]
            return F.struct(p.alias("place"), F.xxhash64(F.lit(mask), *words).alias("seed"))

        return F.transform(places, at)

    each = [of(m) for m in masks]
    return each[0] if len(each) == 1 else F.concat(*each)


def text_key(text_col: str) -> Column:
    """Equal texts share this digest, and are compared once."""
    return F.sha2(text_of(text_col), 256)


def matched_texts(
    docs: DataFrame,
    benchmark: DataFrame,
    stretch: int = STRETCH,
    share: float = SHARE,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``key, item_id, n_equal, n_words, start`` of every distinct text and item that overlap; written."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), plain_words(text_of(item_text)).alias("iw"))
    items = items.filter(F.size("iw") > 0)
    item_seeds = items.withColumn("h", F.transform("iw", lambda w: F.xxhash64(w)))
    judged = F.least(F.size("iw"), F.lit(stretch))
    masks = {r["n"]: mask_of(r["n"], share) for r in items.select(judged.alias("n")).distinct().collect()}
    used = sorted({*masks.values()}, key=MASKS.index) or [MASKS[0]]
    own = F.lit(None).cast(ArrayType(StructType([StructField("place", IntegerType(), False), StructField("seed", LongType(), False)])))
    for m in used:
        own = F.when(judged.isin([n for n, x in masks.items() if x == m]), seeds("h", [m])).otherwise(own)
    item_seeds = item_seeds.select("item_id", F.xxhash64("iw").alias("ik"), F.explode(own).alias("s"))
    item_seeds = written(item_seeds.select("item_id", "ik", F.col("s.place").alias("ip"), F.col("s.seed").alias("seed")).distinct())
    small = item_seeds.count() <= BROADCAST_SEEDS

    rows = docs.select(text_key(text_col).alias("key"), text_of(text_col).alias("text"))
    hashed = rows.select("key", F.transform(plain_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    found = hashed.select("key", F.explode(seeds("h", used)).alias("s"))
    found = found.select("key", F.col("s.place").alias("dp"), F.col("s.seed").alias("seed"))
    hits = found.join(F.broadcast(item_seeds) if small else item_seeds, "seed")
    hits = hits.select("key", "item_id", "ik", (F.col("dp") - F.col("ip")).alias("start"))
    hits = written(hits.groupBy("key", "item_id", "ik").agg(F.collect_set("start").alias("starts")))

    # texts with hits, each once, next to the items they hit
    keys = hits.select("key").distinct()
    texts = rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "key", "left_semi")
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    pairs = hits.join(texts, "key").withColumn("dw", plain_words(F.col("text"))).drop("text")
    pairs = pairs.join(F.broadcast(items) if small else items, "item_id")
    length = F.size("iw")

    def compare(start):
        equal = F.transform("iw", lambda w, i: (F.get("dw", start + i) == w).cast("int"))
        return F.struct(
            F.aggregate(equal, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("n_equal"),
            start.alias("start"),
            F.transform(equal, lambda x: F.coalesce(x, F.lit(0))).alias("equal"),
        )

    pairs = pairs.select("key", "item_id", length.alias("n_words"), F.transform("starts", compare).alias("c"))
    pairs = pairs.select("key", "item_id", "n_words", F.explode("c").alias("c")).select(
        "key", "item_id", "n_words", "c.n_equal", "c.start", "c.equal"
    )
    span = F.least(F.col("n_words"), F.lit(stretch))
    best = F.array_max(
        F.transform(
            F.sequence(F.lit(1), F.col("n_words") - span + 1),
            lambda p: F.aggregate(F.slice("equal", p, span), F.lit(0), lambda a, x: a + x),
        )
    )
    near = pairs.filter(best >= share * span)
    near = near.groupBy("key", "item_id").agg(
        F.max(F.struct("n_equal", (-F.col("start")).alias("back"), "n_words")).alias("m")
    )
    near = near.select("key", "item_id", "m.n_equal", "m.n_words", (-F.col("m.back")).alias("start"))
    return written(near)


def _joined(docs: DataFrame, near: DataFrame, text_col: str, how: str) -> DataFrame:
    """``docs`` and the matches of their texts; the texts are not shuffled while the matches are few."""
    rows = docs.withColumn("__key", text_key(text_col))
    near = near.withColumnRenamed("key", "__k")
    if near.count() <= BROADCAST_KEYS:
        near = F.broadcast(near)
    return rows.join(near, F.col("__key") == F.col("__k"), how)


def overlaps(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``doc_id, item_id, n_equal, n_words, start``: the best overlap of every document and item that overlap.

    ``n_equal`` of the item's ``n_words`` words are equal where the item would start at word ``start``.
    """
    near = matched_texts(docs, benchmark, text_col=text_col, **options)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("__text"))
    found = _joined(rows, near, "__text", "inner")
    return found.select("doc_id", "item_id", *[F.col(c).cast("long").alias(c) for c in ("n_equal", "n_words", "start")])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that overlap an item."""
    near = matched_texts(docs, benchmark, text_col=text_col, **options)
    kept = _joined(without(docs, "__key", "__k"), near.select("key").distinct(), text_col, "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("__key", "__k")])
