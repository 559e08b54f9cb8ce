import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerscan.operators.checks import CHECKS, chain_and, chain_or, result_counts, run_check
from ledgerscan.operators.predicates import Condition, where_conditions, where_tree
from ledgerscan.plans import keyed


@pytest.fixture(scope="module")
def core(spark):
    return spark.createDataFrame(
        [
            (1, "", "", -10.0, dt.datetime(2026, 1, 5, 7, 30), "600.01"),
            (2, "x", None, 20.0, dt.datetime(2026, 1, 10, 12, 0), "601.01"),
            (3, "x", "b", -5.0, dt.datetime(2026, 1, 31, 19, 0), "100.01"),
            (4, "y", "b", 7.0, dt.datetime(2026, 2, 2, 10, 0), "102.01"),
        ],
        "rid int, A string, B string, TUTAR double, TARIH timestamp_ntz, KEBIR string",
    )


def ids(df):
    return sorted(r[0] for r in df.select("rid").collect())


def test_core_checks(core):
    assert ids(run_check(core, "empty", ["A", "B"])) == [1, 2]
    assert ids(run_check(core, "empty", ["A", "B"], method="all")) == [1]
    assert ids(run_check(core, "negative", "TUTAR")) == [1, 3]
    assert ids(run_check(core, "duplicates", "A")) == [2, 3]
    assert ids(run_check(core, "date_between", "TARIH", start_date="2026-01-01", end_date="2026-01-31")) == [1, 2, 3]
    late = run_check(core, "after_hours", "TARIH", work_start="08:00", work_end="18:00", weekend_as_after_hours=False)
    assert ids(late) == [1, 3]


def test_mixed_date_text(spark):
    df = spark.createDataFrame(
        [
            (1, "2026-01-01 00:00:00"),
            (2, "31.01.2026 23:59"),
            (3, "01/15/2026"),
            (4, "2026-02-01"),
            (5, "not a date"),
            (6, "46042"),
        ],
        "rid int, t string",
    )
    assert ids(run_check(df, "date_between", "t", start_date="01.01.2026", end_date="31.01.2026")) == [1, 2, 3, 6]


def test_debit_credit_split(spark):
    df = spark.createDataFrame(
        [(1, 125.5, 10.1, None), (2, -75.25, None, 3.3), (3, 0.0, 0.0, 0.0), (4, None, 5.55, None)],
        "rid int, TUTAR double, BORC double, ALACAK double",
    )
    single = run_check(df, "debit_credit_split", amount_col="TUTAR").orderBy("rid")
    assert [tuple(r) for r in single.select("CALC_DEBIT", "CALC_CREDIT").collect()] == [(125.5, 0), (0, 75.25), (0, 0), (0, 0)]
    two = run_check(df, "debit_credit_split", amount_structure="separate", debit_col="BORC", credit_col="ALACAK")
    assert [tuple(r) for r in two.orderBy("rid").select("CALC_DEBIT", "CALC_CREDIT").collect()] == [
        (10.1, 0),
        (0, 3.3),
        (0, 0),
        (5.55, 0),
    ]


def test_account_chain(spark):
    df = spark.createDataFrame(
        [("600.01", 10), ("601.01", -5), ("700.01", -7), ("602.01", 3)], "KEBIR string, TUTAR long"
    )
    out = chain_and(
        df,
        [
            {"check": "account_codes", "columns": "KEBIR", "include_accounts": "600\n601"},
            {"check": "negative", "columns": "TUTAR"},
        ],
    )
    assert [r.KEBIR for r in out.collect()] == ["601.01"]


def test_duplicate_invoice(spark):
    df = spark.createDataFrame(
        [("F1", "S1", 100.001), (" f1 ", "s1", 100.0), ("F2", "S1", 100.0)], "FATURA string, TEDARIKCI string, TUTAR double"
    )
    out = run_check(df, "duplicate_invoice_payment", ["FATURA", "TEDARIKCI", "TUTAR"]).collect()
    assert len(out) == 2 and {r.group_count for r in out} == {2}


def test_scope_and_counts(core):
    assert ids(run_check(core, "negative", "TUTAR", scope="unmatched")) == [2, 4]
    assert ids(run_check(core, "duplicates", "A", scope="unmatched")) == [1, 4]
    assert ids(run_check(core, "account_codes", "KEBIR", include_accounts="600,601")) == [1, 2]
    assert tuple(result_counts(core, "negative", "TUTAR").first()) == (4, 2, 2)


def test_or_chain_takes_the_first_explanation(core):
    out = chain_or(
        core,
        [
            {"check": "negative", "columns": "TUTAR", "name": "neg"},
            {"check": "duplicates", "columns": "A", "name": "dup"},
        ],
    )
    assert {r.rid: (r.check_name, r.group_count) for r in out.collect()} == {1: ("neg", None), 2: ("dup", 2), 3: ("neg", None)}


def test_unknown_and_missing(core):
    with pytest.raises(ValueError):
        run_check(core, "nonsense", "A")
    with pytest.raises(ValueError):
        run_check(core, "negative", [])
    assert len(CHECKS) == 57


def test_keep_modes_and_group_numbers(core):
    twice = core.withColumn("A", F.lit("same"))
    second = run_check(twice, "duplicates", "A", keep_mode="second", order_by=["rid"])
    first = run_check(twice, "duplicates", "A", keep_mode="first", order_by=["rid"])
    assert ids(second) == [2, 3, 4] and ids(first) == [1, 2, 3]
    numbered = run_check(core, "unique", "A", order_by=["rid"])
    assert {r.rid: r.group_id for r in numbered.collect()} == {1: 1, 4: 3}


def test_null_vouchers_are_a_group(spark):
    df = spark.createDataFrame(
        [(1, "v1", 10.0, 0.0), (2, "v1", 0.0, 10.0), (3, None, 5.0, 0.0), (4, None, 0.0, 2.0), (5, "v2", 1.0, 0.0)],
        "rid int, v string, d double, c double",
    )
    bad = run_check(df, "debit_credit_imbalance", "v", debit_col="d", credit_col="c")
    assert {r.rid: r.difference for r in bad.collect()} == {3: 3.0, 4: 3.0, 5: 1.0}
    assert ids(run_check(df, "single_leg_voucher", voucher_col="v", debit_col="d", credit_col="c")) == [5]


@pytest.mark.parametrize("check,params", [
    ("duplicates", {"columns": ["k"], "min_count": 3}),
    ("unique", {"columns": ["k"]}),
    ("rare_user_transactions", {"columns": ["k"], "max_count": 2}),
])
def test_shuffle_plan_equals_broadcast_plan(spark, rows, monkeypatch, check, params):
    """The salted join for many keys returns what the broadcast join returns, also for hot keys."""
    n = F.col("id")
    key = F.when(n % 3 == 0, "hot").when(n % 3 == 1, (n % 700).cast("string")).otherwise(n.cast("string"))
    df = spark.range(3000).select(n.alias("rid"), F.when(n % 50 != 0, key).alias("k"))
    expected = rows(run_check(df, check, **params), "rid", "group_count")
    monkeypatch.setattr(keyed, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(keyed, "HOT_KEYS", 5)
    monkeypatch.setattr(keyed, "HOT_WEIGHT", 100)
    assert rows(run_check(df, check, **params), "rid", "group_count") == expected
    assert expected


def test_hot_rows_are_spread_by_the_salt(spark):
    """The join exchange of the many-keys plan carries the salt."""
    df = spark.range(2000).select(F.col("id").alias("rid"), F.when(F.col("id") % 2 == 0, "hot").otherwise("x").alias("k"))
    key = {"__key": F.col("k")}
    out = keyed.attach(df, key, keyed.group_stats(df, key, {}), broadcast_rows=0)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan and out.count() == 2000
    assert {(r.k, r["__weight"]) for r in out.select("k", "__weight").distinct().collect()} == {("hot", 1000), ("x", 1000)}


def test_filter_operators_treat_null_as_documented(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0)], "rid int, x double")
    assert ids(where_conditions(df, [Condition("x", "not_between", 0, 10)])) == [2, 3]
    assert ids(where_conditions(df, [Condition("x", "num_not_in", values="5")])) == [2, 3]
    assert ids(where_conditions(df, [Condition("x", "not_equals", 5, dtype="numeric")])) == [3]
    assert ids(where_conditions(df, [Condition("x", "gt", "x")], logic="or")) == []
    assert ids(where_conditions(df, [Condition("x", "date_between", "soon", "later")])) == []
    with pytest.raises(ValueError):
        where_conditions(df, [])
    with pytest.raises(ValueError):
        where_conditions(df, [Condition("x", "nonsense")])


def test_tree_depth(spark):
    df = spark.createDataFrame([(1, 5.0)], "rid int, x double")
    node = Condition("x", "positive")
    for _ in range(5):
        node = {"children": [node]}
    assert ids(where_tree(df, node)) == [1]
    with pytest.raises(ValueError):
        where_tree(df, {"children": [node]})


def test_top_n_breaks_ties_by_order(spark):
    df = spark.createDataFrame([(i, 1.0 if i < 5 else None) for i in range(8)], "rid int, x double")
    assert ids(where_conditions(df, [Condition("x", "top_n", 3)], order_by=["rid"])) == [0, 1, 2]
    assert ids(where_conditions(df, [Condition("x", "bottom_n", 99)], order_by=["rid"])) == [0, 1, 2, 3, 4]
    sample = where_conditions(df, [Condition("x", "random_n", 4)], order_by=["rid"])
    assert len(ids(sample)) == 4 and ids(sample) == ids(sample)


def test_chains_of_grouped_checks(spark):
    n = F.col("id")
    df = spark.range(60).select(n.alias("rid"), (n % 10).alias("a"), (n % 4).alias("b"), (n % 7 - 3).alias("x"))
    chained = chain_and(
        df,
        [
            {"check": "negative", "columns": "x"},
            {"check": "duplicates", "columns": ["a"], "min_count": 3},
            {"check": "duplicates", "columns": ["b"], "min_count": 2},
        ],
    )
    rows = [(i, i % 10, i % 4) for i in range(60) if i % 7 - 3 < 0]
    rows = [r for r in rows if sum(o[1] == r[1] for o in rows) >= 3]
    rows = [r for r in rows if sum(o[2] == r[2] for o in rows) >= 2]
    assert ids(chained) == [r[0] for r in rows] and rows
    either = chain_or(
        df,
        [
            {"check": "rare_user_transactions", "columns": ["x"], "max_count": 8},
            {"check": "top_n", "columns": "x", "n": 3, "order_by": ["rid"]},
            {"check": "duplicates", "columns": ["a", "b"], "min_count": 3},
        ],
    )
    per_x = {x: sum((i % 7 - 3) == x for i in range(60)) for x in range(-3, 4)}
    top = sorted(range(60), key=lambda i: (-(i % 7 - 3), i))[:3]
    pairs = {}
    for i in range(60):
        pairs.setdefault((i % 10, i % 4), []).append(i)
    expected = [i for i in range(60) if per_x[i % 7 - 3] <= 8 or i in top or len(pairs[(i % 10, i % 4)]) >= 3]
    assert ids(either) == expected
