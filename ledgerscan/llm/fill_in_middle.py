"""Fill-in-middle transformation: blocks of a text change places by rotations inside one bytearray.

The bytes of a text are scanned once for the places where a token ends; two of them, drawn from a
digest of the id, cut it into prefix, middle and suffix. A sentinel is put in front of each block in
text order, and one rotation (three reversals in place) brings the blocks into the wanted order:

    psm  <P>prefix <M>middle <S>suffix  ->  <P>prefix <S>suffix <M>middle
    spm  <P>prefix <M>middle <S>suffix  ->  <S>suffix <P>prefix <M>middle

``restore`` finds the sentinels, rotates back and takes them out. As a text that holds a sentinel
stays plain and no sentinel can arise across a cut, what it finds is unambiguous.

Defined results: a null text is the empty text; empty texts are plain with no tokens; a null id is the
empty text in the digest, so such rows with equal texts are cut alike; repeated rows give repeated rows;
the caller's columns stay, but for those with the names of the results; an empty table gives an empty
table. A text of any length is one bytearray of its size, and reversals borrow ``STEP`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerscan.llm.common import prepare, text_of, without

#: The sentinels in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Bytes that change places at a time in a reversal.
STEP = 1 << 16
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True


def cuts(data: bytes) -> np.ndarray:
    """Offsets behind every token: a word with the white space before it, or the white space at the end."""
    white = _WHITE[np.frombuffer(data, np.uint8)]
    ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
    return np.append(ends, len(data)) if data else ends


def code_points(data: bytes) -> int:
    """Code points of UTF-8 bytes: those that do not continue another."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def reverse(view: np.ndarray, low: int, high: int) -> None:
    while high - low > 1:
        size = min((high - low) // 2, STEP)
        left = view[low : low + size].copy()
        view[low : low + size] = view[high - size : high][::-1]
        view[high - size : high] = left[::-1]
        low, high = low + size, high - size


def rotate(buffer: bytearray, low: int, cut: int, high: int) -> None:
    """Exchanges ``buffer[low:cut]`` and ``buffer[cut:high]`` in place."""
    view = np.frombuffer(buffer, np.uint8)
    reverse(view, low, cut)
    reverse(view, cut, high)
    reverse(view, low, high)


def transform(data: bytes, first: int, second: int, form: str) -> bytearray:
    """``data`` with its blocks ``[:first]``, ``[first:second]`` and ``[second:]`` in the order of ``form``."""
    out = bytearray(data)
    out[second:second] = SUFFIX
    out[first:first] = MIDDLE
    out[0:0] = PREFIX
    middle = len(PREFIX) + first
    suffix = second + len(PREFIX) + len(MIDDLE)
    rotate(out, 0 if form == "spm" else middle, suffix, len(out))
    return out


def invert(output: bytes, form: str) -> bytearray:
    """The text behind an output, from nothing but the output and its form."""
    out = bytearray(output)
    if form == "plain":
        return out
    if form == "spm":
        rotate(out, 0, out.index(PREFIX), len(out))
    else:
        rotate(out, out.index(SUFFIX), out.index(MIDDLE), len(out))
    middle = out.index(MIDDLE)
    suffix = out.index(SUFFIX)
    del out[suffix : suffix + len(SUFFIX)]
    del out[middle : middle + len(MIDDLE)]
    del out[: len(PREFIX)]
    return out


def _transformed(key: str, data: bytes, seed: int, share: int, spm_share: int) -> tuple:
    ends = cuts(data)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not data or h[2] % 100 >= share or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, data
    first, second = (int(ends[k - 1]) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    form = "spm" if h[3] % 100 < spm_share else "psm"
    out = transform(data, first, second, form)
    return n, form, code_points(data[:first]), code_points(data[first:second]), bytes(out)


def _text(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, share: int = 50, spm_share: int = 80) -> DataFrame:
    """``df`` with ``n`` tokens, the ``form`` (plain, spm or psm), the sizes of prefix and middle, and the ``output``.

    ``share`` of 100 texts are cut, ``spm_share`` of 100 of those put the suffix first.
    """
    prepare(df.sparkSession)
    kept = without(df, *RESULTS, "__key", "__text")
    if id_col not in kept.columns:
        raise ValueError(f"no column {id_col}, or it has the name of a result")
    given = df.select([F.col(f"`{c}`") for c in kept.columns] + [F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("__key"), text_of(text_col).alias("__text")])
    new = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = (batch.column(batch.num_columns - k) for k in (2, 1))
            rows = [_transformed(k, t, seed, share, spm_share) for k, t in zip(keys.to_pylist(), texts.cast(pa.binary()).to_pylist())]
            n, form, prefix, middle, output = zip(*rows) if rows else [()] * 5
            found = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), _text(list(output))]
            names = [*batch.schema.names[:-2], *RESULTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *found], names=names)

    return given.mapInArrow(work, T.StructType([*kept.schema.fields, *new]))


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", restored_col: str = "restored") -> DataFrame:
    """``df`` with the text behind every output, rebuilt from output and form alone."""
    prepare(df.sparkSession)
    kept = without(df, restored_col, "__output", "__form")
    given = df.select([F.col(f"`{c}`") for c in kept.columns] + [F.col(f"`{form_col}`").alias("__form"), text_of(output_col).alias("__output")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, outputs = (batch.column(batch.num_columns - k) for k in (2, 1))
            texts = [bytes(invert(o, f or "plain")) for f, o in zip(forms.to_pylist(), outputs.cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], _text(texts)], names=[*batch.schema.names[:-2], restored_col])

    return given.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField(restored_col, T.StringType())]))
