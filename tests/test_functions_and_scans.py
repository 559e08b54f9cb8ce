import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ledgerscan.functions import FUNCTIONS, ORDERED_FUNCTIONS, Formula, apply_function, column_function
from ledgerscan.operators import scans


def value(df, fn, cols=(), **args):
    return df.select(column_function(df, fn, cols, **args).alias("r")).first().r


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame(
        [(7.0, -3.0, None, "1.234,50 TL", "", None, dt.datetime(2026, 1, 3, 10, 0), dt.datetime(2026, 1, 1, 12, 0))],
        "a double, b double, n double, t string, e string, z string, d1 timestamp_ntz, d2 timestamp_ntz",
    )


def test_catalogue_is_complete():
    assert len(set(FUNCTIONS) | ORDERED_FUNCTIONS) == 130  # 129 ids and the running sum


CASES = [
    ("excel_mod", ["a", "b"], {}, -2.0),
    ("excel_mod", ["b"], {"divisor": 0}, None),
    ("excel_round", ["a"], {"decimals": -1}, 10.0),
    ("excel_roundup", ["b"], {}, -3.0),
    ("excel_even", ["a"], {}, 8.0),
    ("excel_odd", ["a"], {}, 7.0),
    ("excel_sum", ["a", "n", "t"], {}, 1241.5),
    ("excel_sum", ["n"], {}, 0.0),
    ("excel_product", ["n"], {}, 1.0),
    ("excel_average", ["n"], {}, None),
    ("excel_median", ["a", "b", "n"], {}, 2.0),
    ("excel_stdev_s", ["a"], {}, None),
    ("excel_stdev_p", ["a"], {}, 0.0),
    ("excel_devsq", ["n"], {}, 0.0),
    ("excel_large", ["a", "b"], {"k": 3}, None),
    ("excel_geomean", ["b", "n"], {}, None),
    ("excel_skew", ["a", "b"], {}, 0.0),
    ("excel_sqrt", ["b"], {}, None),
    ("excel_ln", ["b"], {}, None),
    ("excel_acos", ["a"], {}, None),
    ("excel_fact", ["a"], {}, 5040),
    ("excel_fact", ["b"], {}, None),
    ("excel_gcd", ["a", "n"], {}, 7),
    ("excel_lcm", ["a", "n"], {}, 0),
    ("excel_value", ["t"], {}, 1234.5),
    ("excel_isnumber", ["e"], {}, False),
    ("excel_len", ["z"], {}, 0),
    ("excel_right", ["t"], {"n": 0}, "1.234,50 TL"),
    ("excel_right", ["t"], {"n": -9}, "TL"),
    ("excel_left", ["t"], {"n": -9}, "1."),
    ("excel_find", ["t"], {"text": ""}, 1),
    ("excel_find", ["t"], {"text": "tl"}, 0),
    ("excel_search", ["t"], {"text": "tl"}, 10),
    ("excel_substitute", ["t"], {"old": "", "new": "-"}, "-1-.-2-3-4-,-5-0- -T-L-"),
    ("excel_exact", ["t"], {}, False),
    ("excel_textjoin", ["t", "e", "z"], {"sep": "+"}, "1.234,50 TL"),
    ("excel_concat", ["t", "e", "z"], {"sep": "+"}, "1.234,50 TL++"),
    ("excel_rept", ["t"], {"n": 0}, ""),
    ("excel_days", ["d1", "d2"], {}, 1),
    ("excel_days", ["d2", "d1"], {}, -2),
    ("excel_weekday", ["d1"], {}, 6),
    ("excel_weeknum", ["d1"], {}, 1),
    ("excel_iseven", ["n"], {}, False),
    ("excel_isodd", ["b"], {}, True),
    ("np_where", ["n"], {"threshold": 1, "true": "y", "false": "x"}, "x"),
    ("excel_iferror", ["n"], {"fallback": "none"}, "none"),
    ("pd_fillna", ["e"], {"value": "v"}, "v"),
    ("excel_iferror", ["e"], {"fallback": "v"}, ""),
]


@pytest.mark.parametrize("fn,cols,args,expected", CASES)
def test_function_values(one, fn, cols, args, expected):
    assert value(one, fn, cols, **args) == expected


def test_gcd_of_many_pairs(spark):
    pairs = [(a * 37 % 1000, b * 91 % 1000) for a in range(20) for b in range(20)] + [(832040, 514229), (2**40, 2**20)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", column_function(df, "excel_gcd", ["a", "b"]).alias("g"), column_function(df, "excel_lcm", ["a", "b"]).alias("l"))
    for r in got.collect():
        assert (r.g, int(r.l)) == (math.gcd(r.a, r.b), math.lcm(r.a, r.b))


def test_proper_case(spark):
    df = spark.createDataFrame([("o'neil-smith 3rd ABC",)], "t string")
    assert value(df, "excel_proper", ["t"]) == "o'neil-smith 3rd ABC".title()


def test_unknown_function_and_column(one):
    with pytest.raises(ValueError):
        apply_function(one, "excel_nothing", "a")
    with pytest.raises(ValueError):
        apply_function(one, "excel_abs", "missing")
    with pytest.raises(ValueError):
        apply_function(one, "pd_diff", "a")


def test_formula_builtins(one):
    f = Formula(one, as_of="2026-05-06 07:08:09")
    row = one.select(
        f.MOD("a", "b").alias("mod"),
        f.ROUND(f.NUM("t") / 7, 2).alias("round"),
        f.IF(f.NUM("a") > 0, "yes").alias("cond"),
        f.QUARTILE_INC(2, "a", "b").alias("q"),
        f.COUNT("a", "e", "t").alias("count"),
        f.COUNTA("a", "e", "z").alias("counta"),
        f.TODAY().alias("today"),
        f.DAYS("d1", "d2").alias("days"),
        f.POWER("a", 2).alias("power"),
        f.AND(F.lit(True), F.lit("evet")).alias("both"),
    ).first()
    assert tuple(row) == (-2.0, 176.36, "yes", 2.0, 2, 2, dt.datetime(2026, 5, 6), 1, 49.0, True)


def test_user_activity(spark):
    df = spark.createDataFrame(
        [("u1", "1,5", "x"), ("u1", "2", None), (None, "9", "9"), ("u2", "1.5", "1")], "u string, d string, c string"
    )
    out = scans.user_activity(df, "u", "d", "c").collect()
    assert [tuple(r) for r in out] == [("u1", 2, 3.5, 0.0), ("u2", 1, 1.5, 1.0)]


def test_keyword_scan(spark):
    df = spark.createDataFrame(
        [(1, "Hediye çeki"), (2, "hediyelik"), (3, "ÖZEL-HEDİYE"), (4, None), (5, "none")], "rid int, t string"
    )
    whole = scans.keyword_scan(df, ["t"], ["hediye", "özel"], "tam")
    assert whole.columns == [scans.KEYWORDS, "rid", "t"]
    assert {r.rid: r[0] for r in whole.collect()} == {1: "hediye", 3: "hediye, özel"}
    inside = scans.keyword_scan(df, ["t"], ["hediye"], "icerik")
    assert sorted(r.rid for r in inside.collect()) == [1, 2, 3]
    counts = scans.keyword_counts(df, ["t"], ["hediye", "özel", "yok"])
    assert {r.keyword: r.matched for r in counts.collect()} == {"hediye": 2, "özel": 1, "yok": 0}
    assert tuple(scans.keyword_summary(df, ["t"], ["hediye"]).first()) == (5, 2)


def test_unusual_accounts(spark):
    df = spark.createDataFrame(
        [
            ("v1", " 600.1"), ("v1", "120"), ("v2", "600.2"), ("v2", "999"), ("v3", "700"), (None, "600"), ("v4", "600"),
        ],
        "voucher string, account string",
    )
    criteria = [
        {"name": "A", "main": ["600"], "counter": ["120"]},
        {"name": "B", "main": ["999", "700"], "counter": ["120"]},
        {"name": "C", "main": ["1"], "counter": []},
    ]
    out = scans.unusual_accounts(df, "account", "voucher", criteria)
    assert out.columns == ["voucher", "NO_OF_RECORDS", "FLAG_A_ANA", "FLAG_A_KARSI", "UNUSUAL_A", "FLAG_B_ANA", "FLAG_B_KARSI", "UNUSUAL_B", "account"]
    got = sorted((r.voucher, r.UNUSUAL_A, r.UNUSUAL_B, r.FLAG_A_ANA, r.FLAG_B_ANA) for r in out.collect())
    assert got == [("v2", 0, 1, 0, 1), ("v2", 0, 1, 0, 1), ("v2", 1, 0, 1, 0), ("v2", 1, 0, 1, 0), ("v3", 0, 1, 0, 1), ("v4", 1, 0, 1, 0)]
    summary = {r.criterion: (r.unusual_vouchers, r.total_vouchers) for r in scans.unusual_summary(df, "account", "voucher", criteria).collect()}
    assert summary == {"A": (2, 4), "B": (2, 4)}
    assert scans.unusual_accounts(df, "account", "voucher", [criteria[2]]).count() == 0


def test_every_builtin_exists(one):
    """The 76 builtins, each with plausible arguments."""
    f = Formula(one, as_of="2026-05-06")
    one_number = (
        "ABS ROUND ROUNDUP ROUNDDOWN INT TRUNC CEILING FLOOR SQRT EXP LN LOG LOG10 SIGN RADIANS DEGREES SIN COS TAN ASIN ACOS "
        "ATAN SINH COSH TANH ASINH ACOSH ATANH COT SEC CSC EVEN ODD"
    ).split()
    numbers = "SUM PRODUCT AVERAGE MEAN MEDIAN MIN MAX COUNT COUNTA MOD POWER ATAN2 STDEV_P STDEV_S VAR_P VAR_S SKEW KURT".split()
    dates = "YEAR MONTH DAY HOUR MINUTE SECOND WEEKDAY WEEKNUM".split()
    built = {n: getattr(f, n)("a") for n in one_number}
    built.update({n: getattr(f, n)("a", "b") for n in numbers})
    built.update({n: getattr(f, n)("d1") for n in dates})
    built.update({n: getattr(f, n)("t") for n in ["LEN", "UPPER", "LOWER", "TRIM"]})
    built.update({n: getattr(f, n)("t", "e") for n in ["AND", "OR", "CONCAT"]})
    built.update(
        {
            "NOT": f.NOT("t"),
            "PI": f.PI(),
            "TODAY": f.TODAY(),
            "NOW": f.NOW(),
            "IF": f.IF(f.NUM("a") > 0, 1, 2),
            "IFERROR": f.IFERROR("n", 0),
            "TEXTJOIN": f.TEXTJOIN("-", "t", "e"),
            "PERCENTILE_INC": f.PERCENTILE_INC(0.5, "a", "b"),
            "QUARTILE_INC": f.QUARTILE_INC(1, "a", "b"),
            "DAYS": f.DAYS("d1", "d2"),
        }
    )
    assert len(built) == 76
    row = one.select(*[v.alias(n) for n, v in built.items()]).first()
    assert (row.ODD, row.SUM, row.YEAR, row.CONCAT, row.MOD, row.QUARTILE_INC) == (7.0, 4.0, 2026, "1.234,50 TL", -2.0, -0.5)
    with pytest.raises(AttributeError):
        f.NOTHING("a")


def test_number_of_manual_operators():
    from ledgerscan.operators.predicates import COUNTING_OPERATORS, OPERATORS

    assert len(OPERATORS) + len(COUNTING_OPERATORS) == 55
