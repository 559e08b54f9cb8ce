"""Appending datasets by column name."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from ledgerscan.functions.defaults import fill_defaults


def append(frames: Sequence[DataFrame], fill: bool = True) -> DataFrame:
    """All rows of all frames, columns matched by name.

    Columns a frame lacks, and missing values, get the defaults of :func:`fill_defaults`. A column
    with different types in different frames becomes text.
    """
    if not frames:
        raise ValueError("nothing to append")
    types: dict[str, set[str]] = {}
    for df in frames:
        for name, dtype in df.dtypes:
            types.setdefault(name, set()).add(dtype)
    mixed = [n for n, seen in types.items() if len(seen) > 1]
    aligned = [
        df.withColumns({n: df[f"`{n}`"].cast("string") for n in mixed if n in df.columns}) for df in frames
    ]
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned)
    return fill_defaults(out) if fill else out
