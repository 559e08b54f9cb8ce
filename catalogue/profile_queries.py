"""Data quality profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import ACCOUNTS_SQL, accounts, query, rounded, table
from ledgerscan.operators import profile


def _text_sql(relation: str, columns: list[str]) -> str:
    values = " UNION ALL ".join(
        f"SELECT '{n}' AS col, CASE WHEN CAST({n} AS VARCHAR) NOT IN ('', 'nan', 'None') THEN CAST({n} AS VARCHAR) END AS v FROM {relation}"
        for n in columns
    )
    return f"""WITH long AS ({values}),
      vc AS (SELECT col, v, count(*) AS n FROM long GROUP BY 1, 2),
      ranked AS (SELECT col, v || '=' || CAST(n AS VARCHAR) AS e, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS t,
                 row_number() OVER (PARTITION BY col ORDER BY n, v) AS b FROM vc WHERE v IS NOT NULL),
      lists AS (SELECT col, string_agg(e, '; ' ORDER BY t) FILTER (t <= 3) AS top_values,
                string_agg(e, '; ' ORDER BY b) FILTER (b <= 3) AS bottom_values FROM ranked GROUP BY 1),
      sums AS (SELECT col, sum(n) AS total, coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS filled, count(v) AS d,
               count(*) FILTER (v IS NOT NULL AND n = 1) AS ones FROM vc GROUP BY 1),
      ent AS (SELECT col, -sum(n / filled * log2(n / filled)) AS h FROM vc JOIN sums USING (col) WHERE v IS NOT NULL GROUP BY 1)
      SELECT col AS "column", round((total - filled) * 100.0 / total, 2) AS missing_pct, CAST(total - filled AS BIGINT) AS null_count,
        d AS "distinct", ones AS "unique", CAST(filled - ones AS BIGINT) AS duplicate_count, round(coalesce(h, 0), 6) AS entropy,
        top_values, bottom_values FROM sums LEFT JOIN lists USING (col) LEFT JOIN ent USING (col)"""


@query("profile_text", _text_sql(ACCOUNTS_SQL, ["c_nationkey", "balance", "segment"]))
def _text(spark, sf):
    out = profile.text_profile(accounts(spark, sf), ["c_nationkey", "balance", "segment"])
    return out.withColumn("entropy", F.round("entropy", 6))


@query("profile_text_lineitem", _text_sql("lineitem", ["l_returnflag", "l_linenumber", "l_quantity", "l_orderkey"]))
def _text_lines(spark, sf):
    out = profile.text_profile(table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber", "l_quantity", "l_orderkey"])
    return out.withColumn("entropy", F.round("entropy", 6))


def _numeric_sql(relation: str, columns: list[str], digits: int) -> str:
    values = " UNION ALL ".join(f"SELECT '{n}' AS col, CAST({n} AS DOUBLE) AS x FROM {relation}" for n in columns)
    quantiles = ", ".join(f"quantile_cont(x, {p / 100}) AS p{p}" for p in (5, 25, 50, 75, 95))
    return f"""WITH long AS (SELECT * FROM ({values}) WHERE x IS NOT NULL),
      b AS (SELECT col, avg(x) AS mean, var_pop(x) AS var, min(x) AS low, max(x) AS high, {quantiles}, count(*) AS n,
            count(*) FILTER (x < 0) AS neg, count(*) FILTER (x = 0) AS zero FROM long GROUP BY 1),
      m AS (SELECT col, arg_min(x, (-n, x)) AS mode FROM (SELECT col, x, count(*) AS n FROM long GROUP BY 1, 2) GROUP BY 1),
      s AS (SELECT col, avg(pow((x - mean) / sqrt(var), 3)) AS skew, avg(pow((x - mean) / sqrt(var), 4)) - 3 AS kurt,
            count(*) FILTER (x < p25 - 1.5 * (p75 - p25) OR x > p75 + 1.5 * (p75 - p25)) AS outliers
            FROM long JOIN b USING (col) GROUP BY 1)
      SELECT col AS "column", round(mean, {digits}) AS mean, p50 AS median, mode, round(sqrt(var), {digits}) AS std,
        round(var, 2) AS variance, low AS min, high AS max, round(high - low, {digits}) AS range, round(p25, {digits}) AS q1, round(p75, {digits}) AS q3,
        round(p75 - p25, {digits}) AS iqr, round(p5, {digits}) AS percentile_5, round(p25, {digits}) AS percentile_25,
        p50 AS percentile_50, round(p75, {digits}) AS percentile_75, round(p95, {digits}) AS percentile_95,
        round(skew, 6) AS skewness, round(kurt, 6) AS kurtosis, CAST(neg AS BIGINT) AS negative_count, CAST(zero AS BIGINT) AS zero_count,
        CAST(outliers AS BIGINT) AS outlier_count FROM b JOIN m USING (col) JOIN s USING (col)"""


def _numeric(df, columns, digits):
    out = profile.numeric_profile(df, columns).drop("n")
    places = {n: digits for n in ("mean", "std", "range", "q1", "q3", "iqr")}
    places.update({f"percentile_{p}": digits for p in (5, 25, 75, 95)})
    places.update({"variance": 2, "skewness": 6, "kurtosis": 6})
    return out.select(*[rounded(n, places[n]) if n in places else n for n in out.columns])


@query("profile_numeric", _numeric_sql(ACCOUNTS_SQL, ["balance", "c_nationkey"], 5))
def _numbers(spark, sf):
    return _numeric(accounts(spark, sf), ["balance", "c_nationkey"], 5)


@query("profile_numeric_lineitem", _numeric_sql("lineitem", ["l_quantity", "l_discount", "l_extendedprice"], 4))
def _numbers_lines(spark, sf):
    return _numeric(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"], 4)


@query(
    "profile_histogram",
    f"""WITH long AS (SELECT 'balance' AS col, balance AS x FROM {ACCOUNTS_SQL} WHERE balance IS NOT NULL
          UNION ALL SELECT 'c_nationkey', c_nationkey FROM {ACCOUNTS_SQL}),
        b AS (SELECT col, min(x) AS low, max(x) AS high, least(20, greatest(5, floor(sqrt(count(*)))))::INTEGER AS k FROM long GROUP BY 1),
        g AS (SELECT col, i::INTEGER AS bin, low + i * ((high - low) / k) AS e0, low + (i + 1) * ((high - low) / k) AS e1, i = k - 1 AS last
              FROM b, LATERAL (SELECT unnest(range(0, k)) AS i))
        SELECT g.col AS "column", bin, round(any_value(e0), 6) AS bin_start, count(x) AS rows
        FROM g LEFT JOIN long ON long.col = g.col AND x >= e0 AND (x < e1 OR last) GROUP BY 1, 2""",
)
def _histogram(spark, sf):
    return profile.histogram(accounts(spark, sf), ["balance", "c_nationkey"]).withColumn("bin_start", F.round("bin_start", 6))


@query(
    "profile_whole_table",
    f"""WITH t AS ({_text_sql("orders", ["o_orderkey", "o_totalprice", "o_orderpriority"])}),
        n AS ({_numeric_sql("orders", ["o_orderkey", "o_totalprice"], 4)})
        SELECT "column", "distinct", duplicate_count, median, outlier_count FROM t LEFT JOIN n USING ("column")""",
)
def _whole(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    return profile.profile(df).select("column", "distinct", "duplicate_count", "median", "outlier_count")
