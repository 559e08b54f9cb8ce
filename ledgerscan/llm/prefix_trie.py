"""Prefix trie of conversations, built by van Emde Boas recursion over depth.

Conversations are rows (text digest per turn), never nodes in memory. A problem is a range of depths
``[a, a + 2^j)`` below a named prefix. It is cut at half depth: the halves that end there are named, equal
upper halves become one row with the number of conversations behind it (the upper trie), and what lies
below is a forest per named prefix (the lower forests). All problems of one size are solved in the same
Spark job, so there are as many rounds as the longest conversation has binary digits. Ranges of one
depth are the nodes. Totals are then grafted upward through the same cuts: what lies below a cut prefix
is added to the prefix where its range began, again one job a size.

A prefix is named by a digest (128 bits of a SHA-256) of the name it starts from and the turns of its
half, so names need no join and no shared counter; equal digests are taken for equal turns.

Defined results: null role or text is the empty text; turns of one conversation with the same number
stand in the order of their digests, those without a number first; rows without ``conv_id`` belong to no
conversation; repeated rows are turns of their own; an empty table gives no nodes, not even a root; only
the four columns are read, so others cannot clash. The digests of one conversation (40 characters a
turn) are one value; a conversation of millions of turns still fits a task. The ids of
conversations that end at a node are hashed as a stream of sorted pieces, never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscan.llm.common import prepare, text_of, white_words, written
from ledgerscan.plans.keyed import attach

#: Hexadecimal characters of a name or a turn's digest (128 bits of a SHA-256), and of a turn's number of words.
DIGEST, WORDS = 32, 8
WIDTH = DIGEST + WORDS
#: A conversation takes turns from the first one of its block of so many, up to three of them.
BLOCK, BORROWED = 20, 4
#: Ids of conversations are joined in ranges of 2 to this power, then hashed as a stream.
ID_BITS = 14
ROOT = ""
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _sha(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, DIGEST)


def turn_rows(df: DataFrame) -> DataFrame:
    """``conv_id, seq`` of the original conversations: their turns in order, ``WIDTH`` characters each."""
    role, text = text_of("role"), text_of("text")
    words = F.lpad(F.lower(F.hex(F.size(white_words(text)).cast("long"))), WORDS, "0")
    digest = _sha(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = df.filter("conv_id is not null").select("conv_id", F.struct("turn", F.concat(digest, words).alias("d")).alias("at"))
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns"))
    return listed.select("conv_id", F.array_join(F.col("turns").getField("d"), "").alias("seq"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """``conv_id, seq`` of the rebuilt conversations: the first turns from the block's first conversation, then the own ones."""
    own = turns.select("*", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(BORROWED)).alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(BLOCK))).alias("block"))
    firsts = turns.filter(F.pmod("conv_id", F.lit(BLOCK)) == 0)
    firsts = firsts.select(F.col("conv_id").alias("block"), F.substring("seq", 1, (BORROWED - 1) * WIDTH).alias("first"))
    size = (F.col("h") * WIDTH).cast("int")
    head = F.coalesce(F.substr("first", F.lit(1), size), F.lit(""))
    return own.join(firsts, "block", "left").select("conv_id", F.concat(head, F.substr("seq", size + 1, F.length("seq"))).alias("seq"))


def _ends(members: DataFrame) -> DataFrame:
    """``z, ends_sha256``: per distinct sequence, the hash of its conversations' ids, ascending, joined by commas."""
    pieces = members.groupBy("z", F.shiftright(F.col("conv_id").cast("long"), ID_BITS).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, keys, sums = None, None, [], []
        for batch in batches:
            for z, ids in zip(batch.column("z").to_pylist(), batch.column("ids").to_pylist()):
                if z == at:
                    state.update(b",")
                else:
                    if state is not None:
                        keys.append(at)
                        sums.append(state.hexdigest())
                    at, state = z, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], names=["z", "ends_sha256"])
            keys, sums = [], []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([state.hexdigest()], pa.string())], names=["z", "ends_sha256"])

    return pieces.repartition("z").sortWithinPartitions("z", "piece").select("z", "ids").mapInArrow(work, "z string, ends_sha256 string")


def _name(start: Column, part: Column) -> Column:
    return _sha(start, part)


def _merged(items: DataFrame) -> DataFrame:
    """Equal rows of a round as one: how many conversations, the smallest of them, the sequence that ends there."""
    return items.groupBy("a", "s", "e", "seg").agg(F.sum("w").alias("w"), F.min("low").alias("low"), F.max("z").alias("z"))


def conversation_trie(df: DataFrame) -> DataFrame:
    """One row per node, see the module; ``conv_id`` is the smallest member."""
    prepare(df.sparkSession)
    members = written(rebuilt(turn_rows(df)).select("conv_id", _sha(F.col("seq")).alias("z"), "seq"))
    top = written(members.groupBy("seq").agg(F.count(F.lit(1)).alias("w"), F.min("conv_id").alias("low"), F.first("z").alias("z")))
    ends = written(_ends(members.select("z", "conv_id")))
    longest = top.agg(F.max(F.length("seq"))).first()[0] or 0
    rounds = int(longest // WIDTH).bit_length()

    # downward: cut at half depth, all ranges of one size together
    items = top.filter("seq <> ''").select(F.lit(0).cast("long").alias("a"), F.lit(ROOT).alias("s"), F.lit(None).cast("string").alias("e"), F.col("seq").alias("seg"), "w", "low", "z")
    cuts: list[DataFrame] = []  # by size of the half: where a range began (s), the prefix at its cut (c), its end (e)
    for j in reversed(range(rounds)):
        half = (1 << j) * WIDTH
        long_enough, deeper = F.length("seg") >= half, F.length("seg") > half
        cut = items.select("*", F.when(long_enough, _name(F.col("s"), F.substring("seg", 1, half))).alias("c"))
        upper = cut.select("a", "s", F.col("c").alias("e"), F.substring("seg", 1, half).alias("seg"), "w", "low", F.when(~deeper, F.col("z")).alias("z"))
        lower = cut.filter(deeper).select((F.col("a") + (1 << j)).alias("a"), F.col("c").alias("s"), "e", F.substr("seg", F.lit(half + 1), F.length("seg")).alias("seg"), "w", "low", "z")
        cuts.append(written(cut.filter("c is not null").select("s", "c", "e").distinct()))
        items = written(_merged(upper.unionByName(lower)))
    cuts.reverse()

    return _with_totals(items, cuts, top, ends)


def _with_totals(items: DataFrame, cuts: list[DataFrame], top: DataFrame, ends: DataFrame) -> DataFrame:
    words = F.conv(F.substring("seg", DIGEST + 1, WORDS), 16, 10).cast("long")
    root = top.agg(F.min("low").alias("low"), F.sum("w").cast("long").alias("w"), F.max(F.when(F.col("seq") == "", F.col("z"))).alias("z")).filter("low is not null")
    nodes = items.select(F.col("e").alias("node"), F.col("s").alias("parent"), (F.col("a") + 1).alias("depth"), "low", F.col("w").cast("long").alias("w"), ((F.col("w") - 1) * words).alias("own"), "z")
    nodes = nodes.unionByName(root.select(F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "low", "w", F.lit(0).cast("long").alias("own"), "z"))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    # below[x]: (leaves, saved) under x as far as the ranges of the present size go
    leaf = (F.col("n_children") == 0).cast("long")
    below = nodes.filter("parent is not null").groupBy(F.col("parent").alias("x")).agg(F.sum(leaf).alias("leaves"), F.sum("own").alias("saved"))
    sizes = [written(below)]
    for pairs in cuts[:-1] if cuts else []:
        # twice the range: what lies under every cut prefix goes to where the range began
        lifted = pairs.select("s", "c").distinct().join(sizes[-1].withColumnRenamed("x", "c"), "c").select(F.col("s").alias("x"), "leaves", "saved")
        sizes.append(written(_summed(sizes[-1].unionByName(lifted))))
    # full totals, from the deepest kind of cut down to single depths: a prefix gets those of the ends of its range
    full: DataFrame | None = None
    for j in reversed(range(len(cuts))):
        mine = cuts[j].select(F.col("c").alias("x")).distinct()
        part = sizes[j].join(mine, "x", "left_semi")
        if full is not None:
            grafted = cuts[j].filter("e is not null").select("c", "e").distinct().join(full.withColumnRenamed("x", "e"), "e").select(F.col("c").alias("x"), "leaves", "saved")
            part = _summed(part.unionByName(grafted))
            full = written(full.unionByName(part))
        else:
            full = written(part)
    if cuts:
        # the root's range is the whole depth: its upper half and what the cut prefixes carry
        lifted = cuts[-1].filter(F.col("s") == ROOT).select("c").distinct().join(full.withColumnRenamed("x", "c"), "c").select(F.lit(ROOT).alias("x"), "leaves", "saved")
        rooted = _summed(sizes[-1].filter(F.col("x") == ROOT).unionByName(lifted))
        full = full.unionByName(rooted)
        nodes = nodes.join(full.withColumnRenamed("x", "node"), "node", "left")
    else:
        nodes = nodes.withColumn("leaves", F.lit(None).cast("long")).withColumn("saved", F.lit(None).cast("long"))
    nodes = nodes.join(ends, "z", "left")
    nodes = written(nodes.select("node", "parent", "low", "depth", "w", "n_children", (F.coalesce("leaves", F.lit(0)) + leaf).alias("n_leaves"), (F.coalesce("saved", F.lit(0)) + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256")))
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("__parent"), F.col("low").alias("parent_conv_id"), F.col("n_children").alias("__weight"))
    named = attach(nodes, {"__parent": F.col("parent")}, parents)
    return named.select(F.col("low").alias("conv_id"), "depth", "parent_conv_id", F.col("w").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("x").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
