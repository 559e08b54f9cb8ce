"""Quality rules: countable rules, then a log-likelihood ratio of hashed n-grams. DataFrame functions only.

Multinomials over hashed n-grams are counted: over trusted documents, and over the whole corpus. There are
three kinds, each with buckets of its own: whole words, three words in a row, and as the back-off of words
that few documents share their last three letters, case and signs included. A document's score is the sum of the log ratios of all its n-grams over its number of words, so length plays no part; documents
at or above a fixed threshold are kept.

The ratio table has one entry per bucket, whatever the corpus, and is read as a scalar subquery.

Cases: a null or empty text has no words, fails the base rules and has score 0; ties of the threshold
are kept; equal rows get equal results; columns named like a result are replaced, others pass
through; without trusted documents all ratios are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscan.llm.common import text_of, white_words, without, written

#: Characters that count as symbols, and the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Kinds of n-grams, and buckets of each.
KINDS = 3
BUCKETS = 1 << 13
SMOOTHING = 1.0
#: Fitted on labels: trusted texts score -0.33 or more, rejected ones -4.3 or less (sf0.01, sf0.1, check_s).
THRESHOLD = -1.0
#: Trusted ids up to this number (8 bytes each) are broadcast; beyond, Spark joins by shuffle.
BROADCAST_IDS = 4_000_000
RESULTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept",
)

_PLACE_BITS = 24
_LOW = (1 << _PLACE_BITS) - 1


def _window(first: Column, second: Column, third: Column) -> Column:
    """Hash of three words, its lower bits left free for a place."""
    return F.xxhash64(first, second, third).bitwiseAND(F.lit(~_LOW))


def with_counts(df: DataFrame, text: str) -> DataFrame:
    """``df`` (with the array ``__w`` of words) plus the counts of the base rules."""
    lines = F.filter(F.split(F.col(text), "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    # hash of every window of three words in the upper bits, its place in the lower ones; sorted, so
    # that equal windows are neighbours
    place = F.lit(_LOW).cast("long")
    window = F.transform(
        F.when(F.size("__w") > 2, F.slice("__w", F.lit(1), F.size("__w") - 2)).otherwise(F.expr("array()").cast("array<string>")),
        lambda w, i: _window(w, F.get("__w", i + 1), F.get("__w", i + 2)).bitwiseOR(i.cast("long")),
    )
    df = df.withColumn("__lines", lines).withColumn("__s", F.sort_array(window))

    def pair(x, k):
        """The places of a window and of its neighbour in hash order, if their words are equal."""
        i, j = x.bitwiseAND(place).cast("int"), F.get("__s", k + 1).bitwiseAND(place).cast("int")
        equal = F.get("__w", i) == F.get("__w", j)
        for n in (1, 2):
            equal = equal & (F.get("__w", i + n) == F.get("__w", j + n))
        return F.when(equal, F.array(i, j)).otherwise(F.expr("array()").cast("array<int>"))

    # one comparison for every window; the rest is for the few that meet their like
    hits = F.filter(
        F.transform("__s", lambda x, k: F.when(F.shiftright(x, _PLACE_BITS) == F.shiftright(F.get("__s", k + 1), _PLACE_BITS), k)),
        lambda k: k.isNotNull(),
    )
    df = df.withColumn("__k", hits)
    found = F.flatten(F.transform("__k", lambda k: pair(F.get("__s", k), k)))
    df = df.withColumn("__p", F.sort_array(F.array_distinct(found)))
    covered = F.transform("__p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("__p", k + 1) - p, F.lit(3))))
    plain = F.col(text)
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol), F.lit(""))
    return df.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.char_length(F.array_join("__w", "")).cast("long"),
            "n_symbols": (F.char_length(F.col(text)) - F.char_length(plain)).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "n_repeat_words": F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x),
        }
    ).drop("__lines", "__k", "__p")


def base_failed() -> Column:
    many = 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | many


def _zone(kind: int, hashed: Column, buckets: int) -> Column:
    return (hashed.bitwiseAND(F.lit(buckets - 1)) + kind * buckets).cast("int")


def word_bucket(word: Column, buckets: int) -> Column:
    return _zone(0, F.xxhash64(word), buckets)


def ending_bucket(word: Column, buckets: int) -> Column:
    """Bucket of the last three letters."""
    return _zone(1, F.xxhash64(F.substring(word, -3, 3)), buckets)


def window_bucket(window: Column, buckets: int) -> Column:
    """Bucket of three words in a row, from the hash that finds repeated ones."""
    return _zone(2, F.shiftright(window, _PLACE_BITS), buckets)


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """One row: ``llr``, the smoothed log ratio of every bucket. ``trusted`` has the ids in its only column."""
    ids = trusted.select(F.col(trusted.columns[0]).cast("long").alias("__t")).filter("__t is not null").distinct()
    ids = written(ids)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("__i"), text_of(text_col).alias("__text"))
    rows = rows.join(ids, F.col("__i") == F.col("__t"), "left")
    rows = rows.select(F.col("__t").isNotNull().cast("long").alias("t"), white_words(F.col("__text")).alias("__w"))
    near = [F.slice("__w", k, F.size("__w")) for k in (2, 3)]
    # the outer form: a filter inferred from the plain one would split the text several times
    words = rows.select("t", F.explode_outer(F.arrays_zip(F.col("__w").alias("a"), near[0].alias("b"), near[1].alias("c"))).alias("g")).filter("g.a is not null")
    window = F.when(F.col("g.c").isNotNull(), window_bucket(_window(F.col("g.a"), F.col("g.b"), F.col("g.c")), buckets))
    grams = words.select("t", F.explode(F.array(word_bucket(F.col("g.a"), buckets), ending_bucket(F.col("g.a"), buckets), window)).alias("b")).filter("b is not null")
    counts = grams.groupBy("b").agg(F.sum("t").alias("target"), F.count(F.lit(1)).alias("raw"))
    every = docs.sparkSession.range(KINDS * buckets).select(F.col("id").cast("int").alias("b"))
    full = every.join(counts, "b", "left").select(
        "b", F.coalesce("target", F.lit(0)).alias("target"), F.coalesce("raw", F.lit(0)).alias("raw")
    )
    table = written(full.agg(F.sort_array(F.collect_list(F.struct("b", "target", "raw"))).alias("c")))

    def total(of: str) -> Column:
        zones = [F.slice("c", 1 + k * buckets, buckets) for k in range(KINDS)]
        return F.array(*[F.aggregate(z, F.lit(0.0), lambda a, x: a + x[of]) for z in zones])

    both = written(table.select("c", total("target").alias("nt"), total("raw").alias("nr")))
    some = SMOOTHING * buckets

    def ratio(x):
        kind = F.floor(x["b"] / buckets).cast("int")
        target = (x["target"] + SMOOTHING) / (F.get("nt", kind) + some)
        return F.log(target / ((x["raw"] + SMOOTHING) / (F.get("nr", kind) + some))).cast("float")

    none = F.transform("c", lambda x: F.lit(0.0).cast("float"))
    return both.select(F.when(F.get("nt", F.lit(0)) > 0, F.transform("c", ratio)).otherwise(none).alias("llr"))


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    threshold: float = THRESHOLD,
    buckets: int = BUCKETS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` plus the counts, ``base_failed``, ``llr`` and ``kept``. No shuffle of the texts."""
    table = ratio_table(docs, trusted, buckets, id_col, text_col)
    rest = without(docs, *RESULTS, "__text", "__w", "__r", "__lines", "__s", "__k", "__p")
    rows = rest.withColumn("__text", text_of(text_col)).withColumn("__w", white_words(F.col("__text")))
    rows = with_counts(rows, "__text")
    rows = rows.withColumn("__r", table.scalar())  # at most 4 bytes a bucket beside every row
    of_words = F.aggregate("__w", F.lit(0.0), lambda a, w: a + F.get("__r", word_bucket(w, buckets)) + F.get("__r", ending_bucket(w, buckets)))
    total = F.aggregate("__s", of_words, lambda a, s: a + F.get("__r", window_bucket(s, buckets)))
    rows = rows.withColumn("llr", F.when(F.size("__w") > 0, total / F.size("__w")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("base_failed", base_failed())
    # a caller's filter on the verdict must not be pushed below and copy the nested expressions over and
    # over; the row number, always true here, holds it above
    verdict = ~F.col("base_failed") & (F.col("llr") >= threshold)
    rows = rows.withColumn("kept", verdict & (F.monotonically_increasing_id() >= 0))
    return rows.select(*[F.col(f"`{c}`") for c in rest.columns], *RESULTS)
