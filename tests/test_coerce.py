import datetime as dt
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerscan.functions import coerce as c

NUMBERS = [
    ("1.234,50 TL", 1234.5),
    ("1,234.50", 1234.5),
    ("(1.000,25)", -1000.25),
    ("12%", 0.12),
    ("(5%)", -0.05),
    ("1,234,567", None),
    ("1.250", 1.25),
    ("1e3", 1000.0),
    ("-", None),
    ("", None),
    (None, None),
    ("1 234,5", 1234.5),
    ("+5", 5.0),
    (".5", 0.5),
    ("5.", 5.0),
    ("hello", None),
    ("1e80", None),
    (" \t-7 ", -7.0),
]

DATES = [
    ("2026-01-05", dt.datetime(2026, 1, 5)),
    ("2026-1-5 09:05", dt.datetime(2026, 1, 5, 9, 5)),
    ("2026-01-31T10:00:00.123", dt.datetime(2026, 1, 31, 10, 0, 0, 123000)),
    ("31.01.2026 23:59", dt.datetime(2026, 1, 31, 23, 59)),
    ("05/01/2026", dt.datetime(2026, 1, 5)),
    ("01/15/2026", dt.datetime(2026, 1, 15)),
    ("2026-13-01", dt.datetime(2026, 1, 13)),
    ("31.01.26", dt.datetime(2026, 1, 31)),
    ("20260131", dt.datetime(2026, 1, 31)),
    ("15 Jan 2026", dt.datetime(2026, 1, 15)),
    ("Jan 15, 2026", dt.datetime(2026, 1, 15)),
    ("46042", dt.datetime(2026, 1, 20)),
    ("46042.5", dt.datetime(2026, 1, 20, 12)),
    ("2026", dt.datetime(2026, 1, 1)),
    ("01/15/2026 02:30 PM", dt.datetime(2026, 1, 15, 14, 30)),
    ("15 Jan 2026 14:30", dt.datetime(2026, 1, 15, 14, 30)),
    ("20260115 1430", dt.datetime(2026, 1, 15, 14, 30)),
    ("20260115T143005", dt.datetime(2026, 1, 15, 14, 30, 5)),
    ("202601151430", dt.datetime(2026, 1, 15, 14, 30)),
    ("Thursday, January 15, 2026 2:05:07 pm", dt.datetime(2026, 1, 15, 14, 5, 7)),
    ("2026 Jan 15 12:00 AM", dt.datetime(2026, 1, 15)),
    ("15.01.2026 12:15 p.m.", dt.datetime(2026, 1, 15, 12, 15)),
    ("15/01/26 2pm", dt.datetime(2026, 1, 15, 14)),
    ("2026-01-15 11:59:59.123456 PM", dt.datetime(2026, 1, 15, 23, 59, 59, 123456)),
    ("15-Jan-26", dt.datetime(2026, 1, 15)),
    ("Sept 3rd, 2024", dt.datetime(2024, 9, 3)),
    ("March 2024", dt.datetime(2024, 3, 1)),
    ("15 Foo 2026 10:00", None),
    ("15 Jan 2026 25:00", None),
    ("15 Jan 2026 13:00 PM", None),
    ("31 Feb 2026", None),
    ("20261315 1430", None),
    ("31.02.2026", None),
    ("0", None),
    ("2958466", None),
    ("ocak", None),
    (None, None),
]


def test_number_text(spark):
    df = spark.createDataFrame(NUMBERS, "raw string, expected double")
    got = df.select("raw", "expected", c.number_from_text("raw").alias("got")).collect()
    assert [(r.raw, r.got) for r in got] == NUMBERS


def test_number_parameters_follow_the_same_rules():
    for raw, expected in NUMBERS[:-2]:
        assert c.float_param(raw) == expected


def test_date_text(spark):
    df = spark.createDataFrame(DATES, "raw string, expected timestamp_ntz")
    got = df.select("raw", c.timestamp_from_text("raw").alias("got")).collect()
    assert [(r.raw, r.got) for r in got] == DATES


def spoken_number(raw: str) -> float | None:
    """The rules of number text, stated independently."""
    packed = "".join(ch for ch in raw.strip() if ch not in "  ")
    negative = len(packed) >= 2 and packed[0] == "(" and packed[-1] == ")"
    if negative:
        packed = packed[1:-1]
    percent = packed.endswith("%")
    kept = [ch for ch in packed if ch in "0123456789,.-+eE"]
    marks = [ch for ch in kept if ch in ",."]
    if "," in marks and "." in marks:
        other = "." if marks[-1] == "," else ","
        kept = [ch for ch in kept if ch != other]
    text = "".join("." if ch == "," else ch for ch in kept)
    if not re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", text):
        return None
    value = float(text)
    value = -value if negative else value
    value = value / 100 if percent else value
    return value if abs(value) <= 1e75 else None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0123456789,.-+eE()%  TL$", max_size=12), min_size=50, max_size=120))
def test_number_text_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    for row in df.select("raw", c.number_from_text("raw").alias("got")).collect():
        expected = spoken_number(row.raw)
        if expected is None:
            assert row.got is None, row
        else:
            assert row.got == pytest.approx(expected, rel=1e-12), row


def test_value_list():
    assert c.value_list("a; b,A\n\tc,,") == ["a", "b", "c"]
    assert c.value_list(["x", " x ", 3]) == ["x", "3"]
    assert c.value_list("a,A", ignore_case=False) == ["a", "A"]


def test_folding(spark):
    row = spark.range(1).select(
        c.normalized(F.lit(" ŞİŞLİ "), fold=True).alias("a"), c.folded(F.lit("ÇıĞ")).alias("b")
    ).first()
    assert (row.a, row.b) == ("sisli", "cig")
    assert c.fold_word("ÇıĞ") == "cig"
