"""Row-local checks on a streaming DataFrame.

The engine itself has no stream operators; checks that decide from one row are plain expressions
and so work on ``readStream`` tables unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerscan.operators.checks import WHOLE_TABLE, run_check


def check_stream(df: DataFrame, check: str, columns=(), **kwargs) -> DataFrame:
    """The matching rows of a row-local check, for a streaming (or batch) DataFrame."""
    if check in WHOLE_TABLE:
        raise ValueError(f"{check} looks at more than one row; run it on a batch")
    return run_check(df, check, columns, **kwargs)
