"""Token ids in files: frequency-ranked, byte-aligned variable-length coding with control bytes.

Texts are encoded by the tokenizers library. Ids are replaced by their frequency rank over the whole
corpus, so that frequent tokens take one byte. A block holds, apart from each other, the control
bytes (four 2-bit lengths each) and the data bytes (1 to 4 per value, little endian); both directions
are numpy table lookups. Blocks are written in ascending ``doc_id`` order by Spark's own file
committer, so a lost executor leaves no half file, on any file system Spark knows.

Folder: ``ranks/`` holds one file with the ids in rank order, ``blocks/`` one file per range of ids.
Block: ``FRV1``, part, sequence, documents, values (uint32), then null flags (uint8), doc ids (int64),
lengths (uint32), control bytes, data bytes; a line feed ends a block.

Cases: a null text is the empty text (only the end id); a null ``doc_id`` comes first; rows that share
a ``doc_id`` follow each other, ordered by their ids; an empty table gives no blocks; other columns
are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerscan.llm.common import Memory, packed, prepare, shared_folder, text_of, written

MAGIC = b"FRV1"
#: A block is closed at this many values, a file aims at ``FILE_IDS``.
BLOCK_IDS = 1 << 20
FILE_IDS = 1 << 23
#: words remembered by a worker in an Arrow array (some 40 bytes each), chunks of other kinds (40 MB), starts of lines (20 MB)
KNOWN_WORDS = 800_000
KNOWN_CHUNKS = 200_000
KNOWN_STARTS = 100_000
#: letters of the texts whose chunks are looked up together
BLOCK_LETTERS = 1 << 23
#: new words encoded in one call
NEW_WORDS = 4096
#: Latin letters only; a subset of what the byte-level pattern takes for letters
LETTERS = "[A-Za-zÀ-ÖØ-öø-ſ]+"
PLAIN = f"^{LETTERS}$"
TAILS = ".,!?;:%$&#*|"
CLOSED = f"^{LETTERS}(?:[{TAILS}]+|[{TAILS}]*\n{LETTERS}[{TAILS}]*)$"

# length in bytes of the four values of every control byte, and the masks of the lengths
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], dtype=np.uint32)


# -- coding -------------------------------------------------------------------------------------


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ``ranks`` (uint32)."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    code = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    padded[: len(ranks)] = code
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    used = np.arange(4, dtype=np.uint8) <= code[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` values of :func:`pack`."""
    lengths = LENGTHS[np.frombuffer(control, dtype=np.uint8)].ravel()[:count]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    raw = np.frombuffer(data + b"\0\0\0", dtype=np.uint8)
    values = raw[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        values[longer] |= raw[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return values & MASKS[lengths]


def block(part: int, number: int, ids: list, lengths: list[int], ranks: np.ndarray) -> bytes:
    nulls = np.array([i is None for i in ids], dtype=np.uint8)
    plain = np.array([0 if i is None else i for i in ids], dtype="<i8")
    control, data = pack(ranks)
    head = struct.pack("<4sIIIII", MAGIC, part, number, len(ids), len(ranks), len(data))
    return b"".join((head, nulls.tobytes(), plain.tobytes(), np.array(lengths, dtype="<u4").tobytes(), control, data))


def blocks(content: bytes):
    """Every block of a file: part, number, null flags, doc ids, lengths, ranks."""
    at = 0
    while at < len(content):
        magic, part, number, docs, values, size = struct.unpack_from("<4sIIIII", content, at)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at += 24
        nulls = np.frombuffer(content, np.uint8, docs, at)
        at += docs
        ids = np.frombuffer(content, "<i8", docs, at)
        at += 8 * docs
        lengths = np.frombuffer(content, "<u4", docs, at)
        at += 4 * docs
        controls = -(-values // 4)
        ranks = unpack(content[at : at + controls], content[at + controls : at + controls + size], values)
        at += controls + size + 1
        yield part, number, nulls, ids, lengths, ranks


# -- encoding by the library ----------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """Byte to letter of byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, through a bounded memory of chunks.

    Where a single space stands between two characters that are no white space, the byte-level
    pattern always cuts in front of the space and what follows it does not depend on what is before.
    Such chunks are encoded once by the library and remembered. Other texts (special tokens, runs of
    white space) are cut at the safe places only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        top = max([size - 1, *self.tokenizer.get_added_tokens_decoder()])
        self.dtype = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.letters = _byte_letters()
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(sorted(added, key=len, reverse=True))) if added else None
        #: tokens that begin with a space
        self.opening = np.zeros(top + 1, bool)
        self.opening[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token[:1] == self.letters[32]]] = True
        self.known, self.ids, self.id_counts = pa.array([], pa.string()), np.zeros(0, self.dtype), np.zeros(0, np.int64)
        self.words = Chunks(self.chunk, KNOWN_CHUNKS)
        self.tails = Memory(self.piece, 10_000)
        self.starts = Memory(lambda word: self.piece(word.encode().decode("latin-1").translate(self.letters)), KNOWN_STARTS)
        self.words.tails, self.words.starts, self.words.line_break = self.tails, self.starts, self.piece(self.letters[10])

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype=self.dtype).tobytes()

    def piece(self, letters: str) -> bytes:
        """One pre-token in byte letters, by the library's model."""
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def chunk(self, chunk: str) -> bytes:
        """A space and what follows it up to the next safe cut."""
        if _plain(chunk):
            return self.piece("\u0120" + (chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.letters)))
        return self.whole(" " + chunk)

    def start(self, chunk: str) -> bytes:
        """What a text begins with, up to the first safe cut."""
        return self.starts[chunk] if _plain(chunk) else self.whole(chunk) if chunk else b""

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.added is not None and self.added.search(text):
            return self.whole(text)
        if "  " in text or ODD_SPACE.search(text):
            chunks = SAFE_CUT.split(text)
        else:
            chunks = text.split(" ")
        first = self.whole(chunks[0])
        return first + b"".join(map(self.words.__getitem__, chunks[1:]))

    def encode_all(self, texts: pa.Array, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by ``end``, and where each of them ends.

        Every distinct chunk of the texts is looked up once; numpy gathers the ids of all of them.
        """
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary
        index = coded.indices.to_numpy().astype(np.int64)
        # texts that hold a special token, or a space beside white space or an end, go their own way
        length = pc.binary_length(chunks).to_numpy()
        odd = (length == 0) | (pc.binary_length(pc.utf8_trim(chunks, WHITE_LETTERS)).to_numpy() < length)
        alone = np.add.reduceat(odd[index], bounds[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        for token in self.tokenizer.get_added_tokens_decoder().values():
            alone |= pc.match_substring(texts, token.content).to_numpy(zero_copy_only=False)
        special = {k: self.encode(texts[k].as_py()) for k in np.flatnonzero(alone).tolist()}
        # a text begins without a space: its first chunk is an entry of its own, as is the end of a text
        begun = chunks.take(pa.array(index[bounds[:-1]])).to_pylist()
        heads = [special[k] if k in special else self.start(c) for k, c in enumerate(begun)]
        index[bounds[:-1]] = len(chunks) + np.arange(len(heads))
        used = np.zeros(len(chunks) + len(heads), bool)
        used[index[~np.repeat(alone, np.diff(bounds))]] = True
        coding, sizes = self.coded(chunks, used[: len(chunks)])
        apart = [*heads, end]
        coding = np.concatenate([coding, np.frombuffer(b"".join(apart), dtype=self.dtype)])
        sizes = np.concatenate([sizes, self.sizes(apart)])
        index = np.insert(index, bounds[1:], len(sizes) - 1)
        ids, ends = gathered(coding, sizes, index)
        return ids, ends[bounds[1:] + np.arange(len(heads))]

    def coded(self, chunks: pa.Array, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the ``used`` ones of ``chunks`` one after another, and the number of ids of every chunk.

        A word with punctuation or a line break and another word behind it is two entries, so that every word is looked
        up once, whatever follows it.
        """
        cut = pc.match_substring_regex(chunks, CLOSED)
        closed = chunks.filter(cut)
        words = pc.replace_with_mask(chunks, cut, pc.replace_substring_regex(closed, f"(?s)^({LETTERS}).*$", r"\1")).dictionary_encode()
        tails = pc.replace_substring_regex(closed, f"^{LETTERS}", "").dictionary_encode()
        word = words.indices.to_numpy()
        needed = np.zeros(len(words.dictionary), bool)
        needed[word[used]] = True
        coding, counts = self.entries(words.dictionary.filter(pa.array(needed)))
        closing = [*map(self.words.behind, tails.dictionary.to_pylist()), b""]
        sizes = np.zeros(len(needed) + len(closing), np.int64)
        sizes[: len(needed)][needed] = counts
        sizes[len(needed) :] = self.sizes(closing)
        both = np.full((len(chunks), 2), len(sizes) - 1)
        both[:, 0] = np.where(used, word, len(sizes) - 1)
        both[np.flatnonzero(cut.to_numpy(zero_copy_only=False)), 1] = len(needed) + tails.indices.to_numpy()
        both[~used, 1] = len(sizes) - 1
        ids, _ = gathered(np.concatenate([coding, np.frombuffer(b"".join(closing), dtype=self.dtype)]), sizes, both.ravel())
        return ids, sizes[both].sum(axis=1)

    def entries(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks one after another, and the number of ids of each.

        Words are looked up in an Arrow array; new ones go to the library many at a time: behind a space each is a
        pre-token of its own.
        """
        plain = pc.match_substring_regex(chunks, PLAIN)
        words, plain = chunks.filter(plain).cast(pa.string()), plain.to_numpy(zero_copy_only=False)
        place = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy().astype(np.int64)
        fresh = place < 0
        new = words.filter(pa.array(fresh))
        other = [*map(self.words.__getitem__, chunks.filter(pa.array(~plain)).to_pylist())]
        made = [self.new_words(new.slice(lo, NEW_WORDS)) for lo in range(0, len(new), NEW_WORDS)]
        ids = np.concatenate([self.ids, *(m[0] for m in made)])
        sizes = np.concatenate([self.id_counts, *(m[1] for m in made)])
        place[fresh] = len(self.known) + np.arange(len(new))
        room = min(len(new), KNOWN_WORDS - len(self.known))
        index = np.zeros(len(chunks), np.int64)
        index[plain] = place
        index[~plain] = len(sizes) + np.arange(len(other))
        found = gathered(np.concatenate([ids, np.frombuffer(b"".join(other), self.dtype)]), np.concatenate([sizes, self.sizes(other)]), index)[0]
        counts = np.concatenate([sizes, self.sizes(other)])[index]
        if room > 0:
            self.known = pa.concat_arrays([self.known, new.slice(0, room)])
            self.id_counts = sizes[: len(self.known)]
            self.ids = ids[: int(self.id_counts.sum())]
        return found, counts

    def new_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text = " " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)
        at = np.flatnonzero(self.opening[ids])
        if len(at) == len(words):
            return ids, np.diff(at, append=len(ids))
        found = [self.chunk(word) for word in words.to_pylist()]  # a vocabulary whose tokens do not tell where a word begins
        return np.frombuffer(b"".join(found), self.dtype), self.sizes(found)

    def sizes(self, entries: list[bytes]) -> np.ndarray:
        return np.fromiter(map(len, entries), np.int64, len(entries)) // self.dtype.itemsize


def gathered(values: np.ndarray, sizes: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``index`` of ``values``, which holds entries of ``sizes`` one after another, and where each ends."""
    starts = np.cumsum(sizes) - sizes
    lengths = sizes[index]
    ends = np.cumsum(lengths)
    return values[np.repeat(starts[index] - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


def _plain(word: str) -> bool:
    """Latin letters only: one pre-token of the byte-level pattern."""
    return word.isalpha() and (word.isascii() or max(word) < "\u0180")


class Chunks(Memory):
    """Chunks by the words they hold: punctuation after a word, a single line break and the word behind it are pre-tokens of their own."""

    def __missing__(self, key):
        word = key.rstrip(TAILS)
        if word != key and _plain(word):
            return self[word] + self.tails[key[len(word) :]]
        if "\n" in key:
            ended, _, begun = key.partition("\n")
            word, other = ended.rstrip(TAILS), begun.rstrip(TAILS)
            if _plain(word) and _plain(other):
                return b"".join((self[word], self.tail(ended[len(word) :]), self.line_break, self.starts[other], self.tail(begun[len(other) :])))
        return super().__missing__(key)

    def behind(self, rest: str) -> bytes:
        """What stands behind a word: punctuation, or a line break (punctuation before it or not) and a word, punctuation behind it or not."""
        ended, broken, begun = rest.partition("\n")
        if not broken:
            return self.tail(ended)
        word = begun.rstrip(TAILS)
        return b"".join((self.tail(ended), self.line_break, self.starts[word], self.tail(begun[len(word) :])))

    def tail(self, letters: str) -> bytes:
        return self.tails[letters] if letters else b""


# a space beside white space, or at an end of the text; white space here is a superset of any engine's
_WHITE = r"[\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]"
WHITE = frozenset(c for c in map(chr, range(0x10000)) if re.match(_WHITE, c))
WHITE_LETTERS = "".join(sorted(WHITE))
ODD_SPACE = re.compile(rf" (?:{_WHITE}|\Z)|(?:{_WHITE}|\A) ")
SAFE_CUT = re.compile(rf"(?<!{_WHITE})(?<!\A) (?!{_WHITE}|\Z)")


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


# -- Spark ---------------------------------------------------------------------------------------


def token_table(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, ids``: the ids of every text with the end id, as little-endian bytes; written."""
    prepare(docs.sparkSession)

    def encode(batches):
        enc = encoder(path)
        size = enc.dtype.itemsize
        end = np.array([end_id], dtype=enc.dtype).tobytes()

        def coded(held: list) -> pa.RecordBatch:
            docs = pa.concat_arrays([b.column(0) for b in held])
            ids, ends = enc.encode_all(pa.concat_arrays([b.column(1) for b in held]), end)
            bounds = np.concatenate([[0], ends * size])
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(docs), [None, pa.py_buffer(bounds), pa.py_buffer(ids.tobytes())])
            return pa.RecordBatch.from_arrays([docs, pa.array(np.diff(bounds) // size), values.cast(pa.binary())], ["doc_id", "n", "ids"])

        held, letters = [], 0
        for batch in batches:
            held.append(batch)
            letters += batch.column(1).nbytes
            if letters >= BLOCK_LETTERS:
                yield coded(held)
                held, letters = [], 0
        if held:
            yield coded(held)

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return packed(rows.mapInArrow(encode, "doc_id long, n long, ids binary"))


def rank_order(tokens: DataFrame, itemsize: int) -> tuple[np.ndarray, int]:
    """Ids by descending corpus frequency (ties: the smaller id), and the number of all ids.

    Counted in every task, summed by Spark; the driver gets at most one row per vocabulary entry.
    """

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            seen = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=f"<u{itemsize}"))
            if len(seen) > len(total):
                seen[: len(total)] += total
                total = seen
            else:
                total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    rows.sort(key=lambda r: (-r["n"], r["id"]))
    return np.array([r["id"] for r in rows], dtype=np.uint32), sum(r["n"] for r in rows)


def write_token_files(
    docs: DataFrame, tokenizer: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Encodes ``docs`` with the tokenizer file and writes the folder described above."""
    spark = docs.sparkSession
    itemsize = encoder(tokenizer).dtype.itemsize
    tokens = token_table(docs, tokenizer, end_id, id_col, text_col)
    order, total = rank_order(tokens, itemsize)
    table = np.zeros(int(order.max()) + 1 if len(order) else 1, dtype=np.uint32)
    table[order] = np.arange(len(order), dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(table)  # at most the vocabulary
    raw = spark.createDataFrame([(bytearray(order.astype("<u4").tobytes()),)], "value binary").coalesce(1)
    raw.select(F.col("value").cast("string")).write.text(f"{folder}/ranks")

    def code(batches):
        part, number, ids, lengths, values, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        rank = ranks.value

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([block(part, number, ids, lengths, np.concatenate(values))], pa.binary())], ["value"]
            )

        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = rank[np.frombuffer(content, dtype=f"<u{itemsize}")]
                ids.append(doc)
                lengths.append(len(found))
                values.append(found)
                held += len(found)
                if held >= BLOCK_IDS:
                    yield close()
                    number, ids, lengths, values, held = number + 1, [], [], [], 0
        if ids:
            yield close()

    files = max(1, -(-total // FILE_IDS))
    ranged = tokens.select("doc_id", "ids").repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "ids")
    coded = ranged.mapInArrow(code, "value binary")
    coded.select(F.col("value").cast("string")).write.text(f"{folder}/blocks")
    return folder


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """``part, place, doc_id, n_tokens, ids`` of a folder; ids as little-endian unsigned 32-bit integers."""
    return _decoded(spark, folder, "ids binary", lambda ids, a, b: ids[a:b].tobytes(), pa.binary())


def _decoded(spark: SparkSession, folder: str, column: str, value, kind) -> DataFrame:
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt")
    content = whole.load(f"{folder}/ranks").select("content").first()["content"]
    table = np.frombuffer(bytes(content)[:-1], dtype="<u4")
    ids_of = spark.sparkContext.broadcast(table)

    def decode(batches):
        table = ids_of.value
        for batch in batches:
            for content in batch.column(0):
                for part, number, nulls, ids, lengths, ranks in blocks(content.as_py()):
                    found = table[ranks].astype("<u4")
                    ends = np.cumsum(lengths, dtype=np.int64)
                    starts = ends - lengths
                    for lo in range(0, len(ids), 4096):
                        hi = min(lo + 4096, len(ids))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(hi - lo, part), pa.int64()),
                                pa.array((np.int64(number) << 32) + np.arange(lo, hi), pa.int64()),
                                pa.array(ids[lo:hi], pa.int64(), mask=nulls[lo:hi].astype(bool)),
                                pa.array(lengths[lo:hi].astype(np.int64)),
                                pa.array([value(found, starts[k], ends[k]) for k in range(lo, hi)], kind),
                            ],
                            ["part", "place", "doc_id", "n_tokens", column.split()[0]],
                        )

    # rows are whole files; spark.sql.files.maxPartitionBytes bounds how many of them a batch holds
    read = whole.load(f"{folder}/blocks").select("content")
    return read.mapInArrow(decode, f"part long, place long, doc_id long, n_tokens long, {column}")


def token_index(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in a folder, from its files alone."""
    rows = _decoded(
        spark, folder, "ids_crc32 long", lambda ids, a, b: zlib.crc32(ids[a:b].tobytes()) & 0xFFFFFFFF, pa.int64()
    )
    rows = written(rows)
    # one row per file crosses files; inside a file an ordinary window adds up
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(bases, "part").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def new_folder(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/ledgerscan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
