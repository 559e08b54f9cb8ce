"""Toxicity by a small convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and of its first four and six letters. Filters over
one, two and three words run over the whole text, the largest response of each filter is kept, and a
linear layer gives a logit. The threshold is calibrated for each language on labelled rows that the
fit has not seen; the language is told from the function words of the text, never from a column.
``score = 1 / (1 + exp(threshold - logit))``, so 0.5 is the threshold in every language.

Fitted on every labelled row. The rows are dealt by the hash of their id to shards of bounded size, as
buckets of their words. In every epoch each shard goes on from the common model in steps of ``BATCH``
rows, then the models are averaged, an embedding over the shards that moved it: the more rows, the more
shards, on as many cores. One shard is plain sequential fitting. Nothing depends on how files or tasks
are cut. Scoring reads every whole text, without a shuffle.

Cases: null and empty texts are scored like any other (no word: padding only); rows that share a
``doc_id`` are all scored; without labels of both classes every score is the share of label 1 (0 if
there are none); columns are ignored except id and text; an empty table gives no rows.
"""

from __future__ import annotations

import copy
import math
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscan.llm.common import Memory, packed, prepare, text_of
from ledgerscan.plans.tables import apart

BUCKETS = 1 << 15
SIZE = 16
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 8
BATCH = 32
RATE = 0.01
#: Bytes of text in a shard, about as many as its buckets take.
SHARD_BYTES = 24 << 20
#: Labels up to this number are broadcast; beyond, Spark joins by shuffle.
BROADCAST_ROWS = 2_000_000
#: Thresholds are found among logits in steps of one in so many, between plus and minus ``FAR``.
STEPS, FAR = 1 << 10, 64
#: Rows of a language and class that a threshold of its own needs.
CALIBRATION_ROWS = 15
SIGNS = ".,!?;:%&$#*|\"'()[]{}<>-"
SLOTS = [(w, j) for w in WIDTHS for j in range(w)]
#: Filter and shift of every column of the filter parts.
PART = np.array([WIDTHS.index(w) * FILTERS + f for w, _ in SLOTS for f in range(FILTERS)])
SHIFT = np.array([j for _, j in SLOTS for _ in range(FILTERS)])

# fixed values: function words that tell languages apart
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are by this be from or at an".split(),
    "de": "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es".split(),
    "fr": "le la les des du et est une un que qui dans pour pas sur au avec par ne se".split(),
    "es": "el los las del que en un una por con no para su al lo como y se es".split(),
}
_LANGUAGES = sorted(FUNCTION_WORDS)
NAMES = [*_LANGUAGES, "other"]
_OF_WORD: dict[str, list[int]] = {}
for _k, _name in enumerate(_LANGUAGES):
    for _w in FUNCTION_WORDS[_name]:
        _OF_WORD.setdefault(_w, []).append(_k)


def words_of(text: str) -> list[str]:
    return [w.strip(SIGNS) for w in text.lower().split()]


def language(words: list[str]) -> str:
    """The language with the most function words; "other" without any."""
    votes = [0] * len(_LANGUAGES)
    for w in words:
        for k in _OF_WORD.get(w, ()):
            votes[k] += 1
    return _LANGUAGES[votes.index(max(votes))] if any(votes) else "other"


def buckets_of(word: str) -> tuple[int, int, int]:
    """Rows of the embedding table; row 0 is padding."""
    digest, n = xxhash.xxh3_64_intdigest, BUCKETS - 1
    return 1 + digest("0" + word) % n, 1 + digest("1" + word[:4]) % n, 1 + digest("2" + word[:6]) % n


def bucket_bytes(word: str) -> bytes:
    return struct.pack("=3H", *buckets_of(word))


class Model:
    """Embedding, and in ``dense`` bias, weights and offset of the linear layer and the filter parts side by side."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.embedding = (draw.standard_normal((BUCKETS, SIZE)) * 0.1).astype(np.float32)
        self.embedding[0] = 0
        filters = {w: draw.standard_normal((w * SIZE, FILTERS)) * (1.0 / np.sqrt(w * SIZE)) for w in WIDTHS}
        parts = np.concatenate([filters[w][j * SIZE : (j + 1) * SIZE] for w, j in SLOTS], axis=1)
        n = len(WIDTHS) * FILTERS
        self.dense = np.concatenate([np.zeros(n), draw.standard_normal(n) * 0.3, [0], parts.ravel()]).astype(np.float32)
        self.first, self.second = np.zeros_like(self.dense), np.zeros_like(self.dense)  # moments
        self.squares = np.zeros(BUCKETS, np.float32)
        self.step = 0
        self.thresholds: dict[str, float] = {}

    @property
    def bias(self) -> np.ndarray:
        return self.dense[: len(WIDTHS) * FILTERS]

    @property
    def weights(self) -> np.ndarray:
        return self.dense[len(WIDTHS) * FILTERS : 2 * len(WIDTHS) * FILTERS]

    @property
    def offset(self) -> np.float32:
        return self.dense[2 * len(WIDTHS) * FILTERS]

    @property
    def parts(self) -> np.ndarray:
        return self.dense[2 * len(WIDTHS) * FILTERS + 1 :].reshape(SIZE, -1)

    # -- fitting ----------------------------------------------------------------------------

    def _pooled(self, rows: np.ndarray):
        """Largest response of every filter over a text (rows of buckets of its words), and where."""
        padded = np.concatenate([rows, np.zeros((max(WIDTHS), 3), rows.dtype)])
        words = self.embedding.take(padded[:, 0], axis=0)
        words += self.embedding.take(padded[:, 1], axis=0)
        words += self.embedding.take(padded[:, 2], axis=0)
        responses = words @ self.parts
        n = max(1, len(rows))
        best, where = [], []
        for w in WIDTHS:
            slots = [SLOTS.index((w, j)) * FILTERS for j in range(w)]
            response = sum(responses[j : j + n, c : c + FILTERS] for j, c in enumerate(slots))
            at = response.argmax(axis=0)
            best.append(response[at, np.arange(FILTERS)])
            where.append(at)
        return np.concatenate(best) + self.bias, where, padded, words

    def fit_batch(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> None:
        """One step: dense values by Adam, embeddings by their sums of squares."""
        self.step += 1
        pooled, buckets, words = [], [], []
        for rows in texts:
            best, where, padded, embedded = self._pooled(rows)
            at = np.concatenate(where)[PART] + SHIFT
            pooled.append(best), buckets.append(padded[at]), words.append(embedded[at])
        pooled = np.stack(pooled)
        hidden = np.maximum(pooled, 0)
        logits = np.clip(hidden @ self.weights + self.offset, -30, 30)
        error = ((1 / (1 + np.exp(-logits)) - labels) * weight / len(texts)).astype(np.float32)
        back = error[:, None] * self.weights * (pooled > 0)
        own = back[:, PART]  # of every filter part
        parts = np.einsum("bck,bc->kc", np.stack(words), own)
        grads = np.concatenate([back.sum(axis=0), error @ hidden, [error.sum()], parts.ravel()]).astype(np.float32)
        moves = np.repeat((own[:, :, None] * self.parts.T).reshape(-1, SIZE), 3, axis=0)  # of three buckets a word
        touched = np.concatenate(buckets).ravel()
        order = np.argsort(touched, kind="stable")
        rows, starts = np.unique(touched[order], return_index=True)
        total = np.add.reduceat(moves[order], starts, axis=0)
        self.first = 0.9 * self.first + 0.1 * grads
        self.second = 0.999 * self.second + 0.001 * grads**2
        self.dense -= (RATE * (self.first / (1 - 0.9**self.step)) / (np.sqrt(self.second / (1 - 0.999**self.step)) + 1e-8)).astype(np.float32)
        self.squares[rows] += (total**2).mean(axis=1)
        total *= (10 * RATE / (np.sqrt(self.squares[rows]) + 1e-8))[:, None]
        total[rows == 0] = 0
        self.embedding[rows] -= total

    def fit_epoch(self, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, draw: np.random.Generator) -> None:
        order = draw.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            some = order[lo : lo + BATCH]
            self.fit_batch([texts[k] for k in some], labels[some], weight[some])

    def moved(self, start: Model, n: int) -> np.ndarray:
        """What an epoch over ``n`` rows made of ``start``, such that the sum over shards gives ``average``."""
        squares = self.squares - start.squares
        dense = np.concatenate([self.dense, self.first, self.second, [self.step, 1]]) * n
        return np.concatenate([dense, (self.embedding - start.embedding).ravel(), squares, squares > 0]).astype(np.float32)

    def average(self, total: np.ndarray) -> None:
        """Goes on with the mean of shards by their rows, of an embedding over the shards that moved it."""
        n = len(self.dense)
        dense, embedding, squares, times = np.split(total, np.cumsum([3 * n + 2, self.embedding.size, BUCKETS]))
        dense = dense / dense[-1]
        self.dense, self.first, self.second = (x.astype(np.float32) for x in (dense[:n], dense[n : 2 * n], dense[2 * n : 3 * n]))
        self.step = round(float(dense[-2]))
        times = np.maximum(times, 1)
        self.embedding += (embedding.reshape(-1, SIZE) / times[:, None]).astype(np.float32)
        self.squares += (squares / times).astype(np.float32)

    def calibrate(self, logits: np.ndarray, rows: np.ndarray, hits: np.ndarray, languages: list[str]) -> None:
        """Thresholds with the best F1, one for all and one for every language with enough rows.

        ``logits`` stand for ``rows`` rows each, ``hits`` of them with label 1.
        """

        def best(z, n, y):
            z, place = np.unique(-z, return_inverse=True)
            z, n, y = -z, np.cumsum(np.bincount(place, n)), np.cumsum(np.bincount(place, y))
            f1 = 2 * y / (n + y[-1])
            k = int(np.flatnonzero(f1 == f1.max())[-1])
            return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 1)

        self.thresholds = {"": best(logits, rows, hits) if len(logits) else 0.0}
        for name in sorted({*languages}):
            own = np.array([x == name for x in languages])
            if min(hits[own].sum(), (rows - hits)[own].sum()) >= CALIBRATION_ROWS:
                self.thresholds[name] = best(logits[own], rows[own], hits[own])

    # -- scoring ----------------------------------------------------------------------------

    def tables(self) -> np.ndarray:
        """Response of every filter part to every row of the embedding: scoring only looks up and adds."""
        return self.embedding @ self.parts

    def logits(self, texts: list[list[str]], tables: np.ndarray, known: Memory) -> np.ndarray:
        """Logits of texts given as words."""
        index: dict[str, int] = {}
        flat, starts = [], []
        for words in texts:
            starts.append(len(flat))
            flat += [index.setdefault(w, len(index) + 1) for w in words]
            flat += [0] * max(WIDTHS)
        flat = np.array(flat + [0] * max(WIDTHS), np.int64)
        rows = np.zeros((len(index) + 1, 3), np.int64)
        if index:
            rows[1:] = [known[w] for w in index]
        words = tables[rows[:, 0]] + tables[rows[:, 1]] + tables[rows[:, 2]]
        words[0] = 0
        starts = np.array(starts)
        ends = np.append(starts[1:], len(flat) - max(WIDTHS))
        pooled, n = [], len(flat) - max(WIDTHS)
        valid = np.zeros(n, bool)
        for lo, hi in zip(starts, ends, strict=True):
            valid[lo : max(lo + 1, hi - max(WIDTHS))] = True
        for w in WIDTHS:
            response = np.zeros((n, FILTERS), np.float32)
            for j in range(w):
                slot = SLOTS.index((w, j)) * FILTERS
                response += words[flat[j : j + n], slot : slot + FILTERS]
            response[~valid] = -np.inf
            pooled.append(np.maximum.reduceat(response, starts, axis=0))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
        return hidden @ self.weights + self.offset

    def scores(self, texts: list[list[str]], tables: np.ndarray, known: Memory) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        thresholds = np.array([self.thresholds.get(language(t), self.thresholds[""]) for t in texts])
        logits = self.logits(texts, tables, known).astype(np.float64)
        return 1 / (1 + np.exp(np.clip(thresholds - logits, -500, 500)))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``i, place, y, held, t`` of every row with a label 0 or 1; every fourth id is held for calibration."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{label_col}`").cast("int").alias("y"))
    known = known.filter("y in (0, 1) and i is not null").distinct()
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), text_of(text_col).alias("t"))
    held = F.pmod(F.xxhash64(F.lit("held"), "i"), F.lit(4)) == 0
    return rows.join(known, F.col("d") == F.col("i")).select("i", F.xxhash64("i").alias("place"), "y", held.alias("held"), "t")


SHARD = "shard int, y binary, held binary, language binary, n binary, words binary"


def shards(rows: DataFrame, number: int) -> DataFrame:
    """One row a shard: labels, held or not, languages, numbers of words and their buckets, in the order of ``place``; written."""
    prepare(rows.sparkSession)

    def words(batches):
        known = Memory(bucket_bytes, 1 << 18)
        for batch in batches:
            texts = [words_of(t) for t in batch.column(5).to_pylist()]
            found = [b"".join(map(known.__getitem__, t)) for t in texts]
            names = [NAMES.index(language(t)) for t in texts]
            made = [pa.array(names, pa.int32()), pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], ["shard", "i", "place", "y", "held", "language", "words"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("place", "i", "words", "y")]).combine_chunks()
        y, held, names = (table.column(c).to_numpy().astype(np.int8).tobytes() for c in ("y", "held", "language"))
        found = table.column("words").chunk(0)  # their bytes lie one behind the other: one value without a copy
        n = (pc.binary_length(found).to_numpy().astype(np.int64) // 6).tobytes()
        _, ends, data = found.buffers()
        ends = np.frombuffer(ends, np.int32)[[found.offset, found.offset + len(found)]]
        words = pa.BinaryArray.from_buffers(pa.binary(), 1, [None, pa.py_buffer(ends), data])
        columns = [table.column("shard")[:1], *(pa.array([x], pa.binary()) for x in (y, held, names, n)), words]
        return pa.table(columns, ["shard", "y", "held", "language", "n", "words"])

    shard = F.get(F.lit(apart(rows.sparkSession, number)), F.pmod("place", F.lit(number)).cast("int"))  # no two in a task
    rows = rows.select(shard.alias("shard"), "i", "place", "y", "held", "t")
    made = rows.mapInArrow(words, "shard int, i long, place long, y int, held boolean, language int, words binary")
    return packed(made.repartition(number, "shard").groupBy("shard").applyInArrow(joined, SHARD))


def unpacked(batch: pa.RecordBatch):
    """``shard, y, held, language, texts`` of every shard; a text is the rows of buckets of its words."""
    for shard, y, held, names, n, words in zip(*(batch.column(k) for k in range(6)), strict=True):
        ends = np.cumsum(np.frombuffer(n.as_buffer(), np.int64))
        texts = np.split(np.frombuffer(words.as_buffer(), np.uint16).reshape(-1, 3), ends[:-1])
        y, held, names = (np.frombuffer(x.as_buffer(), np.int8) for x in (y, held, names))
        yield shard.as_py(), y, held != 0, names, texts


def train(examples: DataFrame | None, counts: dict[tuple[int, bool], int] | None = None, number: int = 1) -> Model | float:
    """A model of ``number`` shards with ``counts`` rows by label and held or not; the share of label 1 where a class is missing."""
    counts = counts or {}
    of = [sum(n for (y, _), n in counts.items() if y == k) for k in (0, 1)]
    if not all(of):
        return of[1] / max(1, sum(of))
    context = examples.sparkSession.sparkContext
    # both parts need both classes, else all rows are in both
    parted = all(counts.get((y, held)) for y in (0, 1) for held in (True, False))
    fitted = [counts[y, False] if parted else of[y] for y in (0, 1)]
    weights = np.array([0.5 / n * sum(fitted) for n in fitted])
    model = Model()
    for epoch in range(EPOCHS):
        sent = context.broadcast(model)

        def fit(batches, sent=sent, epoch=epoch):
            for batch in batches:
                for shard, y, held, _, texts in unpacked(batch):
                    some = np.flatnonzero(~held) if parted else np.arange(len(y))
                    own = copy.deepcopy(sent.value)
                    own.fit_epoch([texts[k] for k in some], y[some], weights[y[some]], np.random.default_rng([7, epoch, shard]))
                    made = [pa.array([shard], pa.int32()), pa.array([own.moved(sent.value, len(some)).tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(made, ["shard", "moved"])

        def add(table: pa.Table) -> pa.Table:
            table = table.sort_by("shard")
            total = sum(np.frombuffer(x.as_buffer(), np.float32) for x in table.column("moved"))
            return pa.table([table.column("shard")[:1], pa.array([total.tobytes()], pa.binary())], ["shard", "moved"])

        moved = examples.mapInArrow(fit, "shard int, moved binary")
        some = moved.groupBy(F.pmod("shard", F.lit(math.isqrt(number - 1) + 1))).applyInArrow(add, "shard int, moved binary")
        found = sorted(some.collect(), key=lambda r: r["shard"])  # the root of the number of shards
        model.average(sum(np.frombuffer(r["moved"], np.float32) for r in found))
        sent.unpersist()
    sent = context.broadcast(model)

    def logits(batches):
        model = sent.value
        for batch in batches:
            for _, y, held, names, texts in unpacked(batch):
                some = np.flatnonzero(held) if parted else np.arange(len(y))
                z = np.array([np.maximum(model._pooled(texts[k])[0], 0) @ model.weights + model.offset for k in some])
                z = np.round(np.clip(z, -FAR, FAR) * STEPS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (names[some], z, y[some])], ["language", "z", "y"])

    found = examples.mapInArrow(logits, "language long, z long, y long").groupBy("language", "z").agg(F.count("y").alias("n"), F.sum("y").alias("y"))
    found = found.orderBy("language", "z").toArrow()  # as many as steps and languages at most
    names, z, n, y = (found.column(c).to_numpy() for c in ("language", "z", "n", "y"))
    model.calibrate(z / STEPS, n, y, [NAMES[k] for k in names])
    return model


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model | float:
    """A model of all rows of ``docs`` with a label."""
    rows = labelled(docs, labels, id_col, text_col, label_col)
    found = rows.groupBy("y", "held").agg(F.count("y").alias("n"), F.sum(F.octet_length("t")).alias("bytes")).collect()
    number = 1 + sum(r["bytes"] for r in found) // SHARD_BYTES
    counts = {(r["y"], r["held"]): r["n"] for r in found}
    return train(shards(rows, number), counts, number) if len({y for y, _ in counts}) == 2 else train(None, counts)


def score_documents(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted`` of every row."""
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        tables = model.tables() if isinstance(model, Model) else None
        known = Memory(buckets_of, 1 << 18)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = []
            for lo in range(0, len(texts), 64):
                if tables is None:
                    out += [model] * len(texts[lo : lo + 64])
                else:
                    out += model.scores([words_of(t) for t in texts[lo : lo + 64]], tables, known).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``: fitted on labels of rows with crc32(doc_id) mod 5 other than 0."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fitted(docs, labels.filter(~out), "doc_id", "text", "toxic")
    scored = score_documents(docs, model)
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")
