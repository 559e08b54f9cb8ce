"""Sums that do not depend on order, against Python's decimal numbers."""

import random
from decimal import Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from ledgerscan.operators.checks import run_check
from ledgerscan.plans.exact import group_sums

getcontext().prec = 500


@pytest.mark.parametrize("parts", [1, 7])
def test_group_sums_equal_decimals(spark, parts):
    rnd = random.Random(5)
    rows = []
    for key in [*range(40), None]:
        for _ in range(rnd.randint(0, 12)):
            x = rnd.choice([rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-40, 70), round(rnd.uniform(-1e6, 1e6), 2), 5e-324, 0.0, -0.0, None])
            rows += [(key, x, rnd.choice([None, 1e32, 0.1]))] + ([(key, -x, None)] if x is not None and rnd.random() < 0.4 else [])
    df = spark.createDataFrame(rows, "k int, a double, b double").repartition(parts)
    got = group_sums(df, {"k": F.col("k")}, {"a": F.col("a"), "b": F.col("b")}, {"a": {"a": 1}, "gap": {"a": 1, "b": -1}})
    found = {r.k: (r["__weight"], r.a, r.gap) for r in got.collect()}
    assert found == {
        key: (
            len(mine),
            float(sum((Decimal(repr(a)) for _, a, _ in mine if a is not None), Decimal(0))),
            float(sum((Decimal(repr(a)) for _, a, _ in mine if a is not None), Decimal(0)) - sum((Decimal(repr(b)) for _, _, b in mine if b is not None), Decimal(0))),
        )
        for key in {r[0] for r in rows}
        for mine in [[r for r in rows if r[0] == key]]
    }


def test_vouchers_of_every_size(spark):
    rows = [("a", 2e32, None), ("b", 2e32, None), ("b", 2e32, None), ("c", 4e-7, None), ("c", None, 0.0), ("d", 1e32, None), ("d", 0.1, 1e32), ("d", 0.2, 0.3), ("e", 1e-9, 1e-9)]
    df = spark.createDataFrame(rows, "v string, debit double, credit double")
    gaps = {r.v: r.difference for r in run_check(df, "debit_credit_imbalance", "v", debit_col="debit", credit_col="credit").collect()}
    assert gaps == {"a": 2e32, "b": 4e32, "c": 4e-7}
    legs = run_check(df, "single_leg_voucher", "v", voucher_col="v", debit_col="debit", credit_col="credit").collect()
    assert {r.v for r in legs} == {"a", "b", "c", "e"}  # one row, or one side


def test_totals_are_added_up_once(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.lit(1e-7).alias("a"), F.lit(1e32).alias("b"))
    sums = group_sums(df, {"k": F.col("k")}, {"a": F.col("a"), "b": F.col("b")}, {"a": {"a": 1}, "gap": {"a": 1, "b": -1}})
    plan = sums.filter(F.abs("gap") > 0)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    with_lambdas = [line for line in plan if "lambda" in line]
    # one place, per key: neither in a filter over the totals nor where every row is taken apart
    assert len(with_lambdas) == 1 and "Generate inline" in with_lambdas[0], with_lambdas
