"""Character sets beyond the few that Spark names, as column expressions.

A single-byte set is read as ISO-8859-1, where every byte is the character of its number, and the places
that mean something else in the set are translated. The table comes from the codec's own definition.
"""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A set of single bytes gives a character to at least so many of the 256.
_SINGLE = 200


def is_utf8(encoding: str) -> bool:
    return codecs.lookup(encoding).name in ("utf-8", "utf-8-sig", "ascii")


def table(encoding: str) -> str | None:
    """The characters of bytes 0 to 255 (U+FFFD where there is none); None if it is no single-byte set."""
    out = []
    for byte in range(256):
        try:
            out.append(bytes([byte]).decode(encoding))
        except UnicodeDecodeError:
            out.append("�")
    known = [c for c in out if c != "�"]
    return "".join(out) if len(known) >= _SINGLE and all(len(c) == 1 for c in out) else None


def by_lines(encoding: str) -> bool:
    """Whether lines can be told apart before they are decoded."""
    return is_utf8(encoding) or table(encoding) is not None


def translated(latin: Column, encoding: str) -> Column:
    """Text of a single-byte set that was read as ISO-8859-1."""
    chars = table(encoding)
    if chars is None:
        raise ValueError(f"{encoding} is no single-byte character set")
    places = [b for b in range(256) if chars[b] != chr(b)]
    return F.translate(latin, "".join(map(chr, places)), "".join(chars[b] for b in places)) if places else latin


def decoded(data: Column, encoding: str) -> Column:
    """Text of a binary column; what is no character becomes U+FFFD."""
    if is_utf8(encoding):
        return F.make_valid_utf8(data.cast("string"))
    return translated(F.decode(data, "ISO-8859-1"), encoding)


def as_latin(text: Column, encoding: str) -> Column:
    """Text whose ISO-8859-1 bytes are those of ``text`` in a single-byte set; other characters become question marks."""
    chars = table(encoding)
    if chars is None:
        raise ValueError(f"{encoding} is no single-byte character set")
    # what the set does not have goes first, so that no byte stands for a foreign character
    kept = "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(chars) if c != "�")
    places = [b for b in range(256) if chars[b] not in (chr(b), "�")]
    known = F.regexp_replace(text, f"[^{kept}]", "?")
    return F.translate(known, "".join(chars[b] for b in places), "".join(map(chr, places))) if places else known
