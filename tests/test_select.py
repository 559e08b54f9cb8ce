"""Selection by counting and deep pages, with everything above a few rows on the large route."""

import random

import pytest

from ledgerscan.operators import preview
from ledgerscan.operators.checks import result_sample
from ledgerscan.operators.predicates import Condition, where_conditions
from ledgerscan.plans import select


@pytest.fixture
def frame(spark):
    rnd = random.Random(4)
    rows = [(k, rnd.choice([None, 1.5, 1.5, 1.5, -3.0, rnd.uniform(-5, 5), 1e70]), rnd.choice("ab")) for k in range(400)]
    return rows, spark.createDataFrame(rows, "rid int, x double, s string").repartition(6)


@pytest.mark.parametrize("operator", ["top_n", "bottom_n", "random_n"])
def test_large_n_equals_small_n(frame, monkeypatch, operator):
    rows, df = frame
    for n in (1, 2, 77, 200, 330, 399, 400, 900):
        few = where_conditions(df, [Condition("x", operator, n)], order_by=["s", "rid"]).collect()
        with monkeypatch.context() as m:
            m.setattr(select, "SMALL", 0)
            many = where_conditions(df, [Condition("x", operator, n)], order_by=["s", "rid"]).collect()
        assert sorted(few, key=str) == sorted(many, key=str)
        if operator == "top_n":
            best = sorted((r for r in rows if r[1] is not None), key=lambda r: (-r[1], r[2], r[0]))[:n]
            assert sorted(r[0] for r in best) == sorted(r.rid for r in many)


def test_few_rows(spark, monkeypatch):
    monkeypatch.setattr(select, "SMALL", 0)
    for values in ([], [None], [2.0, None]):
        df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "rid int, x double")
        got = where_conditions(df, [Condition("x", "top_n", 1)], order_by=["rid"]).collect()
        assert [r.x for r in got] == [v for v in values if v is not None]


@pytest.mark.parametrize("ascending", [True, False])
def test_deep_pages_cover_all_rows_once(frame, monkeypatch, ascending):
    rows, df = frame
    shallow = [tuple(r) for r in preview.page(df, per=400, sort_by="x", ascending=ascending)[0].collect()]
    monkeypatch.setattr(preview, "SHALLOW", 0)
    pages = [tuple(r) for k in range(6) for r in preview.page(df, page=k, per=70, sort_by="x", ascending=ascending)[0].collect()]
    assert pages == shallow and len(pages) == len(rows)
    unsorted = [tuple(r) for k in range(6) for r in preview.page(df, page=k, per=70)[0].collect()]
    assert sorted(unsorted, key=str) == sorted(rows, key=str)


def test_result_sample(frame):
    rows, df = frame
    got = result_sample(df, "negative", "x", limit=7, order_by=["rid"]).collect()
    assert [r.rid for r in got] == [k for k, x, _ in rows if x is not None and x < 0][:7]
    assert "check_name" in got[0].asDict()
