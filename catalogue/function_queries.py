"""Column functions by id: each query computes a family, one result column per function."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import ACCOUNTS_SQL, POSTINGS_SQL, accounts, add, postings, query, table
from ledgerscan.functions import Formula, apply_function, column_function

# -- several columns of one row ------------------------------------------------------------


def _triples(spark, sf):
    """Three numbers per row, some of them missing."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(k % 7 != 0, F.round(F.col("c_acctbal") / 100, 1)).alias("a"),
        F.when(k % 5 != 0, F.col("c_nationkey")).alias("b"),
        F.when((k % 3 != 0) & (k % 35 != 0), (k % 13).cast("string")).alias("c"),
        F.when(k % 2 == 0, (k % 9 - 4).cast("double")).otherwise(F.lit(6.0)).alias("d"),
    )


_TRIPLES_SQL = """(SELECT *, list_sort(list_filter([a, b, TRY_CAST(c AS DOUBLE), d], lambda v: v IS NOT NULL)) AS v FROM (SELECT c_custkey,
  CASE WHEN c_custkey % 7 <> 0 THEN round(c_acctbal / 100, 1) END AS a,
  CASE WHEN c_custkey % 5 <> 0 THEN c_nationkey END AS b,
  CASE WHEN c_custkey % 3 <> 0 AND c_custkey % 35 <> 0 THEN CAST(c_custkey % 13 AS VARCHAR) END AS c,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 9 - 4 AS DOUBLE) ELSE 6.0 END AS d FROM customer))"""

_COLS = ["a", "b", "c", "d"]


def _family(name, load, key, sql, calls, digits=8, **shared):
    """One query of several functions: ``calls`` maps result column -> (function, columns, arguments)."""

    def build(spark, sf):
        df = load(spark, sf)
        out = []
        for column, (fn, cols, args) in calls.items():
            value = column_function(df, fn, cols, **{**shared, **args})
            dtype = df.select(value.alias("x")).schema[0].dataType.simpleString()
            if dtype.startswith("decimal"):
                value = value.cast("long")
            out.append((F.round(value, digits) if dtype == "double" else value).alias(column))
        return df.select(key, *out)

    add(name, build, sql)


_family(
    "fx_row_totals", _triples, "c_custkey",
    f"""SELECT c_custkey, round(coalesce(list_sum(v), 0), 8) AS excel_sum, round(list_product(v), 8) AS excel_product,
        round(coalesce(list_sum(list_transform(v, lambda x: x * x)), 0), 8) AS excel_sumsq, round(list_avg(v), 8) AS excel_average,
        round(list_avg(v), 8) AS np_mean, round(list_min(v), 8) AS excel_min, round(list_max(v), 8) AS excel_max,
        len(v)::INTEGER AS excel_count FROM {_TRIPLES_SQL}""",
    {n: (n, _COLS, {}) for n in ["excel_sum", "excel_product", "excel_sumsq", "excel_average", "np_mean", "excel_min", "excel_max", "excel_count"]},
)
_family(
    "fx_row_order_statistics", _triples, "c_custkey",
    f"""SELECT c_custkey, round(list_aggregate(v, 'quantile_cont', 0.5), 8) AS excel_median,
        round(list_aggregate(v, 'quantile_cont', 0.9), 8) AS excel_percentile_inc, round(list_aggregate(v, 'quantile_cont', 0.1), 8) AS np_percentile,
        round(list_aggregate(v, 'quantile_cont', 0.25), 8) AS excel_quartile_inc, round(v[len(v) - 1], 8) AS excel_large,
        round(v[3], 8) AS excel_small FROM {_TRIPLES_SQL}""",
    {
        "excel_median": ("excel_median", _COLS, {}),
        "excel_percentile_inc": ("excel_percentile_inc", _COLS, {"q": 0.9}),
        "np_percentile": ("np_percentile", _COLS, {"q": "0.1"}),
        "excel_quartile_inc": ("excel_quartile_inc", _COLS, {"quart": 1}),
        "excel_large": ("excel_large", _COLS, {"k": 2}),
        "excel_small": ("excel_small", _COLS, {"k": 3}),
    },
)
_family(
    "fx_row_spread", _triples, "c_custkey",
    f"""SELECT c_custkey, round(list_stddev_pop(v), 6) AS excel_stdev_p, round(list_stddev_pop(v), 6) AS np_std, round(list_stddev_samp(v), 6) AS excel_stdev_s,
        round(list_var_pop(v), 6) AS excel_var_p, round(list_var_samp(v), 6) AS excel_var_s, round(list_var_pop(v) * len(v), 6) AS excel_devsq
        FROM {_TRIPLES_SQL}""",
    {n: (n, _COLS, {}) for n in ["excel_stdev_p", "np_std", "excel_stdev_s", "excel_var_p", "excel_var_s", "excel_devsq"]}, digits=6,
)
_family(
    "fx_row_moments", _triples, "c_custkey",
    f"""WITH t AS (SELECT *, list_avg(v) AS m, list_stddev_pop(v) AS s, list_filter(v, lambda x: x > 0) AS p FROM {_TRIPLES_SQL})
        SELECT c_custkey, round(CASE WHEN len(v) >= 3 AND s > 1e-12 THEN list_avg(list_transform(v, lambda x: pow((x - m) / s, 3))) ELSE 0 END, 6) AS excel_skew,
        round(CASE WHEN len(v) >= 4 AND s > 1e-12 THEN list_avg(list_transform(v, lambda x: pow((x - m) / s, 4))) - 3 ELSE 0 END, 6) AS excel_kurt,
        round(exp(list_avg(list_transform(p, lambda x: ln(x)))), 6) AS excel_geomean,
        round(len(p) / list_sum(list_transform(p, lambda x: 1 / x)), 6) AS excel_harmean FROM t""",
    {n: (n, _COLS, {}) for n in ["excel_skew", "excel_kurt", "excel_geomean", "excel_harmean"]}, digits=6,
)
_family(
    "fx_row_text_counts", accounts, "c_custkey",
    f"""SELECT c_custkey, ((balance IS NOT NULL)::INTEGER + (coalesce(segment, '') <> '')::INTEGER)::INTEGER AS excel_counta,
        ((balance IS NULL)::INTEGER + (coalesce(segment, '') = '')::INTEGER)::INTEGER AS excel_countblank FROM {ACCOUNTS_SQL}""",
    {n: (n, ["balance", "segment"], {}) for n in ["excel_counta", "excel_countblank"]},
)


def _whole_pairs(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 60).alias("b"), F.lit("12").alias("c")
    )


_family(
    "fx_gcd_lcm", _whole_pairs, "o_orderkey",
    """SELECT o_orderkey, gcd(gcd(o_custkey, o_orderkey % 60), 12)::BIGINT AS excel_gcd,
       lcm(o_custkey, o_orderkey % 60)::BIGINT AS excel_lcm FROM orders""",
    {"excel_gcd": ("excel_gcd", ["a", "b", "c"], {}), "excel_lcm": ("excel_lcm", ["a", "b"], {})},
)

# -- one number ------------------------------------------------------------------------------


def _scaled(spark, sf):
    """A nullable amount around zero, and small arguments for the trigonometric functions."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey",
        F.when(k % 9 != 0, F.col("c_acctbal") - 2000).alias("x"),
        ((k % 41 - 20) / 8.0).alias("t"),
        (k % 7 - 3).cast("double").alias("y"),
        (k % 27 - 2).alias("n"),
    )


_SCALED_SQL = """(SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal - 2000 END AS x, (c_custkey % 41 - 20) / 8.0 AS t,
  CAST(c_custkey % 7 - 3 AS DOUBLE) AS y, c_custkey % 27 - 2 AS n FROM customer)"""

_family(
    "fx_rounding", _scaled, "c_custkey",
    f"""SELECT c_custkey, abs(x) AS excel_abs, round_even(x / 10, 0) * 10 AS excel_round, ceil(x * 10) / 10 AS excel_roundup,
        floor(x * 10) / 10 AS excel_rounddown, floor(x) AS excel_int, trunc(x) AS excel_trunc, ceil(x / 25) * 25 AS excel_ceiling,
        floor(x / 25) * 25 AS excel_floor, ceil(x / 2) * 2 AS excel_even,
        CASE WHEN ceil(x) % 2 = 0 THEN ceil(x) + 1 ELSE ceil(x) END AS excel_odd FROM {_SCALED_SQL}""".replace("abs(x)", "round(abs(x), 8)"),
    {
        "excel_abs": ("excel_abs", ["x"], {}),
        "excel_round": ("excel_round", ["x"], {"decimals": -1}),
        "excel_roundup": ("excel_roundup", ["x"], {"decimals": 1}),
        "excel_rounddown": ("excel_rounddown", ["x"], {"decimals": 1}),
        "excel_int": ("excel_int", ["x"], {}),
        "excel_trunc": ("excel_trunc", ["x"], {}),
        "excel_ceiling": ("excel_ceiling", ["x"], {"significance": 25}),
        "excel_floor": ("excel_floor", ["x"], {"significance": 25}),
        "excel_even": ("excel_even", ["x"], {}),
        "excel_odd": ("excel_odd", ["x"], {}),
    },
)
_family(
    "fx_powers_and_logs", _scaled, "c_custkey",
    f"""SELECT c_custkey, round(CASE WHEN y <> 0 THEN x - floor(x / y) * y END, 6) AS excel_mod, round(CASE WHEN t >= 0 OR y = floor(y) THEN
          CASE WHEN t = 0 AND y < 0 THEN NULL ELSE pow(t, y) END END, 6) AS excel_power, round(t * t, 6) AS np_power,
        round(CASE WHEN x >= 0 THEN sqrt(x) END, 6) AS excel_sqrt, round(CASE WHEN x >= 0 THEN sqrt(x) END, 6) AS np_sqrt, round(exp(t), 6) AS excel_exp,
        round(CASE WHEN x > 0 THEN ln(x) END, 6) AS excel_ln, round(CASE WHEN x > 0 THEN ln(x) END, 6) AS np_log,
        round(CASE WHEN x > 0 THEN log2(x) END, 6) AS excel_log, round(CASE WHEN x > 0 THEN log10(x) END, 6) AS excel_log10,
        CAST(sign(x) AS DOUBLE) AS excel_sign, round(pi(), 6) AS excel_pi, CASE WHEN x IS NOT NULL THEN round(greatest(-1, least(1, x)), 6) END AS np_clip,
        CASE WHEN x > 100 THEN 'big' ELSE 'small' END AS np_where, coalesce(n % 2 = 0, false) AS excel_iseven, n % 2 <> 0 AS excel_isodd,
        CASE WHEN n BETWEEN 0 AND 170 THEN coalesce(list_product(list_transform(range(1, n::INTEGER + 1), lambda k: k::DOUBLE)), 1) END AS excel_fact, x IS NOT NULL AS excel_isnumber FROM {_SCALED_SQL}""",
    {
        "excel_mod": ("excel_mod", ["x", "y"], {}),
        "excel_power": ("excel_power", ["t", "y"], {}),
        "np_power": ("np_power", ["t"], {"power": 2}),
        "excel_sqrt": ("excel_sqrt", ["x"], {}),
        "np_sqrt": ("np_sqrt", ["x"], {}),
        "excel_exp": ("excel_exp", ["t"], {}),
        "excel_ln": ("excel_ln", ["x"], {}),
        "np_log": ("np_log", ["x"], {}),
        "excel_log": ("excel_log", ["x"], {"base": 2}),
        "excel_log10": ("excel_log10", ["x"], {}),
        "excel_sign": ("excel_sign", ["x"], {}),
        "excel_pi": ("excel_pi", [], {}),
        "np_clip": ("np_clip", ["x"], {"min": -1, "max": 1}),
        "np_where": ("np_where", ["x"], {"threshold": 100, "true": "big", "false": "small"}),
        "excel_iseven": ("excel_iseven", ["n"], {}),
        "excel_isodd": ("excel_isodd", ["n"], {}),
        "excel_fact": ("excel_fact", ["n"], {}),
        "excel_isnumber": ("excel_isnumber", ["x"], {}),
    },
    digits=6,
)

_TRIG = {
    "radians": "radians(t)", "degrees": "degrees(t)", "sin": "sin(t)", "cos": "cos(t)", "tan": "tan(t)",
    "asin": "CASE WHEN abs(t) <= 1 THEN asin(t) END", "acos": "CASE WHEN abs(t) <= 1 THEN acos(t) END", "atan": "atan(t)",
    "sinh": "sinh(t)", "cosh": "cosh(t)", "tanh": "tanh(t)", "asinh": "asinh(t)", "acosh": "CASE WHEN t >= 1 THEN acosh(t) END",
    "atanh": "CASE WHEN abs(t) < 1 THEN atanh(t) END", "cot": "CASE WHEN t <> 0 THEN 1 / tan(t) END", "sec": "1 / cos(t)",
    "csc": "CASE WHEN t <> 0 THEN 1 / sin(t) END", "coth": "CASE WHEN t <> 0 THEN 1 / tanh(t) END", "sech": "1 / cosh(t)",
    "csch": "CASE WHEN t <> 0 THEN 1 / sinh(t) END",
}
_family(
    "fx_trigonometry", _scaled, "c_custkey",
    f"""SELECT c_custkey, {", ".join(f"round({e}, 8) AS excel_{n}" for n, e in _TRIG.items())}, round(atan2(t, y), 8) AS excel_atan2
        FROM (SELECT c_custkey, CAST(t AS DOUBLE) AS t, y FROM {_SCALED_SQL})""",
    {**{f"excel_{n}": (f"excel_{n}", ["t"], {}) for n in _TRIG}, "excel_atan2": ("excel_atan2", ["t", "y"], {})},
)


def _texted(spark, sf):
    raw = F.when(F.col("c_custkey") % 4 == 0, F.lit("n/a")).otherwise(
        F.concat(F.translate(F.col("c_acctbal").cast("string"), ".", ","), F.lit(" TL"))
    )
    return table(spark, sf, "customer").select("c_custkey", raw.alias("raw"))


_family(
    "fx_value", _texted, "c_custkey",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS excel_value,
       CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS pd_to_numeric FROM customer""",
    {"excel_value": ("excel_value", ["raw"], {}), "pd_to_numeric": ("pd_to_numeric", ["raw"], {})},
)

# -- text ------------------------------------------------------------------------------------


def _words(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.when(k % 6 != 0, F.concat(F.lit("  "), "p_name", F.lit("-o'neil\u0007 3rd "))).alias("w"),
        F.when(k % 2 == 0, F.lit("")).otherwise(F.col("p_type")).alias("v"),
        "p_type",
    )


_WORDS_SQL = """(SELECT p_partkey, CASE WHEN p_partkey % 6 <> 0 THEN '  ' || p_name || '-o''neil' || chr(7) || ' 3rd ' END AS w,
  CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END AS v, p_type, coalesce(CASE WHEN p_partkey % 6 <> 0 THEN '  ' || p_name || '-o''neil' || chr(7) || ' 3rd ' END, '') AS s
  FROM part)"""

_PROPER = """CASE WHEN s = '' THEN '' ELSE '  ' || (SELECT upper(p[1][1]) || p[1][2:] || ' ' || upper(p[2][1]) || p[2][2:]
  FROM (SELECT string_split(split_part(trim(s), '-', 1), ' ') AS p)) || '-O''Neil' || chr(7) || ' 3Rd ' END"""
_family(
    "fx_text", _words, "p_partkey",
    f"""SELECT p_partkey, length(s)::INTEGER AS excel_len, upper(s) AS excel_upper, lower(s) AS excel_lower, trim(s) AS excel_trim, {_PROPER} AS excel_proper,
        replace(s, chr(7), '') AS excel_clean, v = p_type AS excel_exact, instr(s, 'r')::INTEGER AS excel_find, instr(lower(s), 'e')::INTEGER AS excel_search,
        substr(s, 1, 3) || '##' || substr(s, 6) AS excel_replace, replace(s, 'e', '[E]') AS excel_substitute, replace(s, ' ', '') AS pd_replace,
        repeat(v, 3) AS excel_rept, s || '/' || v AS excel_concat, concat_ws('+', nullif(s, ''), nullif(v, '')) AS excel_textjoin,
        s || '+' || v AS excel_textjoin_all, substr(s, 1, 5) AS excel_left, substr(s, 3, 4) AS excel_mid, right(s, 4) AS excel_right, s AS excel_right_zero,
        regexp_matches(s, 'R(ed|ing|OD)', 'i') AS pd_contains FROM {_WORDS_SQL}""",
    {
        **{n: (n, ["w"], {}) for n in ["excel_len", "excel_upper", "excel_lower", "excel_trim", "excel_proper", "excel_clean"]},
        "excel_exact": ("excel_exact", ["v", "p_type"], {}),
        "excel_find": ("excel_find", ["w"], {"text": "r"}),
        "excel_search": ("excel_search", ["w"], {"text": "E"}),
        "excel_replace": ("excel_replace", ["w"], {"start": 4, "length": 2, "new": "##"}),
        "excel_substitute": ("excel_substitute", ["w"], {"old": "e", "new": "[E]"}),
        "pd_replace": ("pd_replace", ["w"], {"old": " ", "new": ""}),
        "excel_rept": ("excel_rept", ["v"], {"n": 3}),
        "excel_concat": ("excel_concat", ["w", "v"], {"sep": "/"}),
        "excel_textjoin": ("excel_textjoin", ["w", "v"], {"sep": "+"}),
        "excel_textjoin_all": ("excel_textjoin", ["w", "v"], {"sep": "+", "ignore_empty": "false"}),
        "excel_left": ("excel_left", ["w"], {"n": 5}),
        "excel_mid": ("excel_mid", ["w"], {"start": 3, "n": 4}),
        "excel_right": ("excel_right", ["w"], {"n": 4}),
        "excel_right_zero": ("excel_right", ["w"], {"n": 0}),
        "pd_contains": ("pd_contains", ["w"], {"text": "r(ed|ing|od)"}),
    },
)
_family(
    "fx_text_documents", lambda s, sf: table(s, sf, "documents"), "doc_id",
    """SELECT doc_id, length(text)::INTEGER AS excel_len, lower(text) AS excel_lower, replace(text, chr(10), '') AS excel_clean,
       instr(lower(text), 'heitü')::INTEGER AS excel_search, right(text, 20) AS excel_right FROM documents""",
    {
        "excel_len": ("excel_len", ["text"], {}),
        "excel_lower": ("excel_lower", ["text"], {}),
        "excel_clean": ("excel_clean", ["text"], {}),
        "excel_search": ("excel_search", ["text"], {"text": "HEITÜ"}),
        "excel_right": ("excel_right", ["text"], {"n": 20}),
    },
)

# -- dates and logic --------------------------------------------------------------------------


def _moments(spark, sf):
    other = F.timestamp_add("HOUR", (F.col("event_id") % 4000 - 2000).cast("int") * 7, F.col("ts"))
    shown = F.when(F.col("event_id") % 8 != 0, F.date_format("ts", "dd.MM.yyyy HH:mm:ss"))
    return table(spark, sf, "events").select("event_id", "ts", other.alias("other"), shown.alias("shown"))


_MOMENTS_SQL = """(SELECT event_id, ts, ts + to_hours((event_id % 4000 - 2000)::BIGINT * 7) AS other,
  CASE WHEN event_id % 8 <> 0 THEN date_trunc('second', ts) END AS shown FROM events)"""
_ELAPSED = "floor(date_diff('microsecond', {0}, {1}) / 86400000000.0)"
_PARTS = {"year": "year", "month": "month", "day": "day", "hour": "hour", "minute": "minute", "second": "second",
          "weekday": "isodow", "weeknum": "week"}
_family(
    "fx_dates", _moments, "event_id",
    f"""SELECT event_id, {", ".join(f"{f}(shown)::INTEGER AS excel_{n}" for n, f in _PARTS.items())}, year(ts)::INTEGER AS pd_year,
        month(ts)::INTEGER AS pd_month, day(ts)::INTEGER AS pd_day, {_ELAPSED.format("other", "ts")}::BIGINT AS excel_days,
        {_ELAPSED.format("ts", "other")}::BIGINT AS excel_datedif, floor({_ELAPSED.format("ts", "other")} / 30.4375)::BIGINT AS excel_datedif_months,
        floor({_ELAPSED.format("ts", "other")} / 365.25)::BIGINT AS excel_datedif_years, shown::TIMESTAMP AS pd_to_datetime,
        TIMESTAMP '2024-02-29 00:00:00' AS excel_today, TIMESTAMP '2024-02-29 10:20:30' AS excel_now FROM {_MOMENTS_SQL}""",
    {
        **{f"excel_{n}": (f"excel_{n}", ["shown"], {}) for n in _PARTS},
        **{f"pd_{n}": (f"pd_{n}", ["ts"], {}) for n in ("year", "month", "day")},
        "excel_days": ("excel_days", ["ts", "other"], {}),
        "excel_datedif": ("excel_datedif", ["ts", "other"], {}),
        "excel_datedif_months": ("excel_datedif", ["ts", "other"], {"unit": "M"}),
        "excel_datedif_years": ("excel_datedif", ["ts", "other"], {"unit": "y"}),
        "pd_to_datetime": ("pd_to_datetime", ["shown"], {}),
        "excel_today": ("excel_today", [], {}),
        "excel_now": ("excel_now", [], {}),
    },
    as_of="2024-02-29 10:20:30",
)


def _flags(spark, sf):
    k = F.col("c_custkey")
    return accounts(spark, sf).select(
        "c_custkey",
        "balance",
        "segment",
        F.when(k % 3 == 0, " EVET").when(k % 3 == 1, "no").alias("p"),
        (k % 2 == 0).alias("q"),
        F.when(k % 4 == 0, F.lit(float("inf"))).otherwise(F.col("balance")).alias("r"),
    )


_FLAGS_SQL = f"""(SELECT c_custkey, balance, segment, c_custkey % 3 = 0 AS p, c_custkey % 2 = 0 AS q FROM {ACCOUNTS_SQL})"""
_family(
    "fx_logic", _flags, "c_custkey",
    f"""SELECT c_custkey, p AND q AS excel_and, p OR q AS excel_or, NOT p AS excel_not, CASE WHEN p THEN 'evet' ELSE 'False' END AS excel_if,
        CASE WHEN c_custkey % 4 = 0 THEN -1.0 ELSE coalesce(balance, -1.0) END AS excel_iferror, coalesce(segment, 'x') AS excel_iferror_text,
        coalesce(segment, '') = '' AS excel_isblank, coalesce(nullif(segment, ''), 'none') AS pd_fillna FROM {_FLAGS_SQL}""",
    {
        "excel_and": ("excel_and", ["p", "q"], {}),
        "excel_or": ("excel_or", ["p", "q"], {}),
        "excel_not": ("excel_not", ["p"], {}),
        "excel_if": ("excel_if", ["p"], {"true": "evet"}),
        "excel_iferror": ("excel_iferror", ["r"], {"fallback": "-1"}),
        "excel_iferror_text": ("excel_iferror", ["segment"], {"fallback": "x"}),
        "excel_isblank": ("excel_isblank", ["segment"], {}),
        "pd_fillna": ("pd_fillna", ["segment"], {"value": "none"}),
    },
)

# -- whole columns and ordered functions -------------------------------------------------------


@query("fx_zscore", f"""SELECT c_custkey, round((balance - avg(balance) OVER ()) / stddev_pop(balance) OVER (), 6) AS z FROM {ACCOUNTS_SQL}""")
def _zscore(spark, sf):
    return apply_function(accounts(spark, sf), "np_zscore", "balance", "z").select("c_custkey", F.round("z", 6).alias("z"))


@query(
    "fx_correlation",
    """SELECT o_orderkey, round(corr(o_totalprice, o_custkey) OVER (), 6) AS r, round(covar_pop(o_totalprice, o_custkey) OVER (), 2) AS cov FROM orders""",
)
def _correlation(spark, sf):
    df = table(spark, sf, "orders")
    df = apply_function(df, "excel_correl", ["o_totalprice", "o_custkey"], "r")
    df = apply_function(df, "excel_covariance_p", ["o_totalprice", "o_custkey"], "cov")
    return df.select("o_orderkey", F.round("r", 6).alias("r"), F.round("cov", 2).alias("cov"))


LINES_SQL = """(SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CAST(round(l_extendedprice * 100) AS BIGINT)) AS line FROM lineitem)"""


def lines(spark, sf):
    """Rows of lineitem in their whole width; numbers of an order repeat, so their text key takes more columns."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    parts = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents]
    return table(spark, sf, "lineitem").withColumn("line", F.concat_ws("-", *parts))


def _ordered(name, fn, sql_value, source=accounts, relation=ACCOUNTS_SQL, key="c_custkey", column="balance",
             partition_by=(), digits=6, **args):
    def build(spark, sf):
        out = apply_function(source(spark, sf), fn, column, "result", order_by=[key], partition_by=partition_by, **args)
        value = F.round("result", digits).alias("result") if out.schema["result"].dataType.simpleString() == "double" else "result"
        return out.select(key, *partition_by, value)

    shown = ", ".join([key, *partition_by])
    add(name, build, f"SELECT {shown}, {sql_value} AS result FROM {relation}")


_ordered("fx_rank_eq", "excel_rank_eq", "CASE WHEN balance IS NOT NULL THEN rank() OVER (ORDER BY balance DESC NULLS LAST) END")
_ordered("fx_rank_eq_ascending", "excel_rank_eq", "rank() OVER (ORDER BY c_nationkey)", column="c_nationkey", ascending="true")
_ordered("fx_rank_eq_partitioned", "excel_rank_eq",
         "rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC)", source=lambda s, sf: table(s, sf, "lineitem"),
         relation="lineitem", key="l_orderkey", column="l_quantity", partition_by=("l_returnflag",))
_ordered("fx_dense_rank", "pd_rank", "CASE WHEN balance IS NOT NULL THEN dense_rank() OVER (ORDER BY balance NULLS LAST) END")
_ordered("fx_diff", "pd_diff", "round(balance - lag(balance, 2) OVER (ORDER BY c_custkey), 6)", periods=2)
_ordered("fx_diff_forward", "pd_diff", "round(balance - lead(balance, 1) OVER (ORDER BY c_custkey), 6)", periods=-1)
_ordered("fx_diff_partitioned", "pd_diff",
         "round(balance - lag(balance, 1) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 6)",
         partition_by=("c_nationkey",))
_ordered("fx_pct_change", "pd_pct_change", "round(f / lag(f) OVER (ORDER BY c_custkey) - 1, 6)",
         relation=f"(SELECT c_custkey, last_value(balance IGNORE NULLS) OVER (ORDER BY c_custkey) AS f FROM {ACCOUNTS_SQL})")
_ordered("fx_rolling_mean", "pd_rolling_mean",
         "round(avg(balance) OVER (ORDER BY c_custkey ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6)", window=5)
_ordered("fx_rolling_mean_partitioned", "pd_rolling_mean",
         "round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6)",
         source=postings, relation=POSTINGS_SQL, key="o_orderkey", column="o_totalprice", partition_by=("o_orderpriority",))
_ordered("fx_rolling_mean_far", "pd_rolling_mean",
         "round(avg(l_quantity) OVER (ORDER BY line ROWS BETWEEN 99999 PRECEDING AND CURRENT ROW), 6)",
         source=lines, relation=LINES_SQL, key="line", column="l_quantity", window=100_000)
_ordered("fx_rolling_mean_far_partitioned", "pd_rolling_mean",
         "round(avg(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY line ROWS BETWEEN 999 PRECEDING AND CURRENT ROW), 6)",
         source=lines, relation=LINES_SQL, key="line", column="l_quantity", partition_by=("l_returnflag",), window=1000)
_ordered("fx_diff_far", "pd_diff",
         "round(l_quantity - lag(l_quantity, 20000) OVER (PARTITION BY l_returnflag ORDER BY line), 6)",
         source=lines, relation=LINES_SQL, key="line", column="l_quantity", partition_by=("l_returnflag",), periods=20_000)
_ordered("fx_cumsum", "cumsum", "round(coalesce(sum(balance) OVER (ORDER BY c_custkey), 0), 4)", digits=4)
_ordered("fx_cumsum_partitioned", "cumsum",
         "round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey), 2)", source=postings,
         relation=POSTINGS_SQL, key="o_orderkey", column="o_totalprice", partition_by=("o_orderpriority",), digits=2)


@query(
    "fx_formula_builtins",
    f"""SELECT c_custkey, round(coalesce(balance, 0) + c_nationkey, 6) AS added, (balance IS NOT NULL)::INTEGER + 1 AS numbers,
        (balance IS NOT NULL)::INTEGER + (segment IS NOT NULL)::INTEGER AS raw_values,
        CASE WHEN balance > 0 THEN 'credit' ELSE '' END AS side, round(coalesce(balance, 0), 6) AS safe,
        coalesce(segment, '') || '-' || c_nationkey AS joined, round((c_nationkey + c_custkey) / 2, 6) AS middle,
        floor(c_custkey / 10.0) * 10 AS tens, round(pow(c_nationkey, 2), 6) AS squared, upper(coalesce(segment, '')) AS up,
        greatest(c_nationkey, c_custkey)::DOUBLE AS high FROM {ACCOUNTS_SQL}""",
)
def _builtins(spark, sf):
    df = accounts(spark, sf)
    f = Formula(df)
    return df.select(
        "c_custkey",
        F.round(f.SUM("balance", "c_nationkey"), 6).alias("added"),
        f.COUNT("balance", "segment", "c_nationkey").alias("numbers"),
        f.COUNTA("balance", "segment").alias("raw_values"),
        f.IF(f.NUM("balance") > 0, "credit").alias("side"),
        F.round(f.IFERROR("balance", 0), 6).alias("safe"),
        f.TEXTJOIN("-", "segment", "c_nationkey").alias("joined"),
        F.round(f.PERCENTILE_INC(0.5, "c_nationkey", "c_custkey"), 6).alias("middle"),
        f.ROUNDDOWN("c_custkey", -1).alias("tens"),
        F.round(f.POWER("c_nationkey", 2), 6).alias("squared"),
        f.UPPER(f.TXT("segment")).alias("up"),
        f.MAX("c_nationkey", "c_custkey").alias("high"),
    )


@query(
    "fx_builtins_moments",
    f"""WITH t AS (SELECT *, list_avg(v) AS m, list_stddev_pop(v) AS s FROM {_TRIPLES_SQL})
        SELECT c_custkey, round(list_aggregate(v, 'quantile_cont', 0.75), 6) AS upper_quartile,
        round(CASE WHEN len(v) >= 3 AND s > 1e-12 THEN list_avg(list_transform(v, lambda x: pow((x - m) / s, 3))) ELSE 0 END, 6) AS skew,
        round(CASE WHEN len(v) >= 4 AND s > 1e-12 THEN list_avg(list_transform(v, lambda x: pow((x - m) / s, 4))) - 3 ELSE 0 END, 6) AS kurt
        FROM t""",
)
def _builtin_moments(spark, sf):
    df = _triples(spark, sf)
    f = Formula(df)
    return df.select(
        "c_custkey",
        F.round(f.QUARTILE_INC(3, *_COLS), 6).alias("upper_quartile"),
        F.round(f.SKEW(*_COLS), 6).alias("skew"),
        F.round(f.KURT(*_COLS), 6).alias("kurt"),
    )


@query(
    "fx_builtins_today",
    f"""SELECT event_id, TIMESTAMP '2024-02-29 00:00:00' AS today, TIMESTAMP '2024-02-29 10:20:30' AS now,
        {_ELAPSED.format("other", "ts")}::BIGINT AS days FROM {_MOMENTS_SQL}""",
)
def _builtin_today(spark, sf):
    df = _moments(spark, sf)
    f = Formula(df, as_of="2024-02-29 10:20:30")
    return df.select("event_id", f.TODAY().alias("today"), f.NOW().alias("now"), f.DAYS("ts", "other").cast("long").alias("days"))


@query(
    "fx_gcd_lcm_beyond_long",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN gcd(c_custkey, 12)::BIGINT END AS divisor,
       CASE WHEN c_custkey % 3 > 0 THEN lcm(c_custkey, 12)::DOUBLE END AS multiple FROM customer""",
)
def _beyond_long(spark, sf):
    """A value no long can hold gives null for its row and leaves the others alone."""
    k = F.col("c_custkey")
    df = table(spark, sf, "customer").select("c_custkey", F.when(k % 3 > 0, k.cast("double")).otherwise(F.lit(1e19)).alias("x"), F.lit(12).alias("y"))
    df = apply_function(df, "excel_gcd", ["x", "y"], "divisor")
    df = apply_function(df, "excel_lcm", ["x", "y"], "multiple")
    return df.select("c_custkey", F.col("divisor").cast("long").alias("divisor"), F.col("multiple").cast("double").alias("multiple"))


@query(
    "fx_factorial_to_170",
    """SELECT c_custkey, CASE WHEN c_custkey % 180 <= 170 THEN
         coalesce(list_product(list_transform(range(1, (c_custkey % 180) + 1), lambda k: k::DOUBLE)), 1) END AS f FROM customer""",
)
def _factorial(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 180).alias("n"))
    return apply_function(df, "excel_fact", "n", "f").select("c_custkey", "f")


# -- builtins, one family a query: name -> (arguments, SQL over u in [0, 1), n in 0..24, k > 0) ---------

_BUILTIN_ROWS = """(SELECT c_custkey + 1 AS k, c_nationkey AS n, c_nationkey / 25.0 AS u, c_acctbal AS b, c_name AS t,
  TIMESTAMP '2024-01-31 22:15:30' + to_days(c_custkey::INTEGER) AS d FROM customer)"""
_BUILTINS = {
    "fx_builtins_rounding": {
        "ABS": (["b"], "abs(b)"),
        "ROUND": (["k", -1], "round_even(k, -1)"),
        "ROUNDUP": (["u", 1], "ceil(round(u * 10, 9)) / 10"),
        "INT": (["b"], "floor(b)"),
        "TRUNC": (["b"], "trunc(b)"),
        "SIGN": (["b"], "sign(b)"),
        "MOD": (["k", "n"], "CASE WHEN n <> 0 THEN k % n END"),
        "EVEN": (["n"], "n + n % 2"),
        "ODD": (["n"], "CASE WHEN n % 2 = 1 THEN n ELSE n + 1 END"),
    },
    "fx_builtins_powers": {
        "SQRT": (["k"], "sqrt(k)"),
        "EXP": (["u"], "exp(u)"),
        "LN": (["k"], "ln(k)"),
        "LOG10": (["k"], "log10(k)"),
        "LOG": (["k", 2], "log2(k)"),
        "RADIANS": (["n"], "radians(n)"),
        "DEGREES": (["u"], "degrees(u)"),
    },
    "fx_builtins_trigonometry": {
        "SIN": (["n"], "sin(n)"),
        "COS": (["n"], "cos(n)"),
        "TAN": (["n"], "tan(n)"),
        "ASIN": (["u"], "asin(u)"),
        "ACOS": (["u"], "acos(u)"),
        "ATAN": (["n"], "atan(n)"),
        "ATAN2": (["k", "n"], "atan2(k, n)"),
        "SINH": (["u"], "sinh(u)"),
        "COSH": (["u"], "cosh(u)"),
        "TANH": (["u"], "tanh(u)"),
        "ASINH": (["n"], "asinh(n)"),
        "ACOSH": (["k"], "acosh(k)"),
        "ATANH": (["u"], "atanh(u)"),
        "COT": (["k"], "1 / tan(k)"),
        "SEC": (["n"], "1 / cos(n)"),
        "CSC": (["k"], "1 / sin(k)"),
    },
    "fx_builtins_statistics": {
        "AVERAGE": (["k", "n", "u"], "(k + n + u) / 3"),
        "MEAN": (["k", "n"], "(k + n) / 2"),
        "MEDIAN": (["k", "n", "u"], "list_median([k, n, u])"),
        "MIN": (["k", "n"], "least(k, n)"),
        "STDEV_P": (["k", "n"], "list_stddev_pop([k, n])"),
        "STDEV_S": (["k", "n"], "list_stddev_samp([k, n])"),
        "VAR_P": (["k", "n"], "list_var_pop([k, n])"),
        "VAR_S": (["k", "n"], "list_var_samp([k, n])"),
    },
    "fx_builtins_dates": {
        "YEAR": (["d"], "year(d)"),
        "MONTH": (["d"], "month(d)"),
        "DAY": (["d"], "day(d)"),
        "HOUR": (["d"], "hour(d)"),
        "MINUTE": (["d"], "minute(d)"),
        "SECOND": (["d"], "second(d)"),
    },
    "fx_builtins_calendar": {
        "WEEKDAY": (["d"], "isodow(d)"),
        "WEEKNUM": (["d"], "week(d)"),
    },
    "fx_builtins_steps_and_truth": {
        "CEILING": (["b"], "ceil(b)"),
        "FLOOR": (["b"], "floor(b)"),
        # truth is read from text: of numbers only 1 is a true word
        "AND": (["n", "n"], "n = 1"),
        "OR": (["k", "n"], "k = 1 OR n = 1"),
        "NOT": (["n"], "n <> 1"),
    },
}


def _family(calls):
    def build(spark, sf):
        k = F.col("c_custkey")
        day = F.expr("TIMESTAMP_NTZ '2024-01-31 22:15:30' + make_dt_interval(cast(c_custkey as int))")
        df = table(spark, sf, "customer").select(
            (k + 1).alias("k"), F.col("c_nationkey").alias("n"), (F.col("c_nationkey") / 25.0).alias("u"), F.col("c_acctbal").alias("b"), F.col("c_name").alias("t"), day.alias("d")
        )
        f = Formula(df)
        return df.select("k", *[F.round(getattr(f, name)(*args).cast("double"), 6).alias(name.lower()) for name, (args, _) in calls.items()])

    return build


for _name, _calls in _BUILTINS.items():
    _columns = ", ".join(f"round(({sql})::DOUBLE, 6) AS {name.lower()}" for name, (_, sql) in _calls.items())
    add(_name, _family(_calls), f"SELECT k, {_columns} FROM {_BUILTIN_ROWS}")


@query(
    "fx_builtins_text_and_logic",
    """SELECT c_custkey, length(c_name)::BIGINT AS len, lower(c_name) AS lower, trim('  ' || c_name || ' ') AS trim,
       c_name || '-' || c_mktsegment AS concat, pi() AS pi, c_custkey AS col FROM customer""",
)
def _text_builtins(spark, sf):
    df = table(spark, sf, "customer")
    f = Formula(df)
    padded = F.concat(F.lit("  "), "c_name", F.lit(" "))
    return df.select(
        "c_custkey",
        f.LEN("c_name").cast("long").alias("len"),
        f.LOWER("c_name").alias("lower"),
        f.TRIM(padded).alias("trim"),
        f.CONCAT("c_name", "c_mktsegment", sep="-").alias("concat"),
        f.PI().alias("pi"),
        f.COL("c_custkey").alias("col"),
    )
