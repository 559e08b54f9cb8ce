"""BPE encoding and decoding with forced boundaries.

Two neighbouring symbols that never stand side by side inside any vocabulary token can never be
merged, so there a cut is certain. Words are cut at all such places, the fragments are merged on
their own (and remembered, as they repeat far more than words do), and the ids are concatenated.

Normalisation and word splitting follow the tokenizer file; the library does them itself for texts
beyond Latin letters, where tables of Unicode versions could differ.

Cases: null and empty texts have no ids and decode to the empty text; special tokens in a text are
found as the library finds them; rows repeat as they come; columns named like a result are replaced,
others pass through.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscan.llm.common import Memory, prepare, text_of, without
from ledgerscan.llm.token_files import _byte_letters

#: words and fragments remembered by a worker: 50 MB and 10 MB
KNOWN_WORDS = 250_000
KNOWN_FRAGMENTS = 50_000
SHORT = 40
ODD = re.compile("[\x1c-\x1f]")


class ForcedBoundaryBpe:
    """A byte-level BPE tokenizer file with an end-of-word suffix (or none) and no decoder."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.normalize = self.library.normalizer.normalize_str if self.library.normalizer else str
        self.pre_tokenize = self.library.pre_tokenizer.pre_tokenize_str
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.letters = _byte_letters()
        self.inner = {c: vocab[c] for c in self.letters.values()}
        self.final = {c: vocab[c + suffix] for c in self.letters.values()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (k, vocab[a + b]) for k, (a, b) in reversed([*enumerate(merges)])}
        #: neighbours inside some token; all others are certain cuts
        self.inside: set[tuple[int, int]] = set()
        for token in vocab:
            ended = bool(suffix) and token.endswith(suffix) and token != suffix
            body = token[: -len(suffix)] if ended else token
            if any(c not in self.inner for c in body):
                continue
            row = [self.inner[c] for c in body]
            if ended and row:
                row[-1] = self.final[body[-1]]
            self.inside.update(zip(row, row[1:], strict=False))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(map(re.escape, self.special), key=len, reverse=True)
        self.specials = re.compile(f"({'|'.join(names)})") if names else None
        steps = spec["pre_tokenizer"]["pretokenizers"] if spec["pre_tokenizer"]["type"] == "Sequence" else []
        split = [s["pattern"]["Regex"] for s in steps if s["type"] == "Split"]
        self.words = regex.compile(split[0]).findall if split else None
        self.plain = self.words is not None and self._plain(spec)
        self.names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in [*vocab.items(), *self.special.items()]:
            self.names[i] = token
        self.dtype = np.dtype("<u4")
        self.known = Memory(self.chunk, KNOWN_WORDS)
        self.fragments = Memory(self.fragment, KNOWN_FRAGMENTS)

    @staticmethod
    def _plain(spec: dict) -> bool:
        """Whether normalising is composing, white space to a space, lower case, in this order."""
        steps = (spec["normalizer"] or {}).get("normalizers", [])
        kinds = [(s["type"], s.get("pattern", {}).get("Regex")) for s in steps]
        return kinds == [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]

    # -- words ------------------------------------------------------------------------------

    def word(self, letters: str) -> list[int]:
        """Ids of one word in byte letters."""
        row = [self.inner[c] for c in letters]
        row[-1] = self.final[letters[-1]]
        out: list[int] = []
        start = 0
        for k in range(1, len(row) + 1):
            if k == len(row) or (row[k - 1], row[k]) not in self.inside:
                out += row[start:k] if k == start + 1 else self.fragments[tuple(row[start:k])]
                start = k
        return out

    def fragment(self, row: tuple[int, ...]) -> list[int]:
        return self.merge_short([*row]) if len(row) <= SHORT else self.merge_long([*row])

    def merge_short(self, row: list[int]) -> list[int]:
        merges = self.merges
        while len(row) > 1:
            best = None
            for k in range(len(row) - 1):
                m = merges.get((row[k], row[k + 1]))
                if m is not None and (best is None or m[0] < best[0]):
                    best, at = m, k
            if best is None:
                break
            row[at : at + 2] = [best[1]]
        return row

    def merge_long(self, row: list[int]) -> list[int]:
        """The same with a heap: n log n for letters without any certain cut."""
        merges, n = self.merges, len(row)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m[0], k, row[k], row[k + 1]) for k in range(n - 1) if (m := merges.get((row[k], row[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            right = after[k]
            if row[k] != a or right < 0 or row[right] != b:
                continue
            row[k], row[right] = merges[a, b][1], -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
                if m := merges.get((row[k], row[after[k]])):
                    heapq.heappush(heap, (m[0], k, row[k], row[after[k]]))
            if before[k] >= 0 and (m := merges.get((row[before[k]], row[k]))):
                heapq.heappush(heap, (m[0], before[k], row[before[k]], row[k]))
        return [i for i in row if i >= 0]

    # -- texts ------------------------------------------------------------------------------

    def chunk(self, chunk: str) -> bytes:
        """What stands between white space in a normalised text of Latin letters."""
        ids: list[int] = []
        for word in self.words(chunk):
            ids += self.word(word.encode().decode("latin-1").translate(self.letters))
        return np.array(ids, dtype=self.dtype).tobytes()

    def part(self, text: str) -> bytes:
        """A text without special tokens."""
        if self.plain and not ODD.search(text):
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return b"".join(map(self.known.__getitem__, text.lower().split()))
        ids: list[int] = []
        for word, _ in self.pre_tokenize(self.normalize(text)):
            ids += self.word(word)
        return np.array(ids, dtype=self.dtype).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials is None or not self.specials.search(text):
            return self.part(text) if text else b""
        out = []
        for piece in self.specials.split(text):
            if piece in self.special:
                out.append(np.array([self.special[piece]], dtype=self.dtype).tobytes())
            elif piece:
                out.append(self.part(piece))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space: what a tokenizer file without a decoder means."""
        names = self.names
        return " ".join([names[i] for i in np.frombuffer(ids, dtype=self.dtype).tolist()])


@functools.cache
def tokenizer(path: str) -> ForcedBoundaryBpe:
    return ForcedBoundaryBpe(path)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` plus ``ids`` (little-endian uint32 bytes), ``n_tokens`` and ``decoded``. No shuffle."""
    prepare(docs.sparkSession)
    rest = without(docs, "ids", "n_tokens", "decoded", "__text")
    rows = rest.withColumn("__text", text_of(text_col)).drop(text_col)
    kept = [f for f in rows.schema.fields if f.name != "__text"]

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(ids, pa.binary()),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([bpe.decode(i) for i in ids], pa.string()),
                ],
                [*batch.schema.names[:-1], "ids", "n_tokens", "decoded"],
            )

    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

    out = StructType(
        [*kept, StructField("ids", BinaryType()), StructField("n_tokens", LongType()), StructField("decoded", StringType())]
    )
    return rows.select(*[F.col(f"`{f.name}`") for f in kept], "__text").mapInArrow(run, out)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document."""
    found = encode_decode(docs.select("doc_id", "text"), path)
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
