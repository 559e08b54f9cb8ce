"""Joins, group-by, whole-column reducers, appends, and the preview query."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import ACCOUNTS_SQL, LEDGER_SQL, accounts, add, ledger, query, rounded, table
from ledgerscan.operators import aggregate as agg
from ledgerscan.operators import joins, preview
from ledgerscan.operators.setops import append

# -- joins -------------------------------------------------------------------------------

_LEFT_SQL = f"(SELECT c_custkey, segment, balance AS amount FROM {ACCOUNTS_SQL})"
_RIGHT_SQL = """(SELECT CASE WHEN n_nationkey = 3 THEN NULL WHEN n_nationkey = 4 THEN 'OTHER'
  ELSE CASE n_nationkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'FURNITURE' END END AS segment,
  CAST(n_nationkey AS DOUBLE) AS amount, n_name FROM nation)"""


def _left(spark, sf):
    return accounts(spark, sf).select("c_custkey", "segment", F.col("balance").alias("amount"))


def _right(spark, sf):
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, "BUILDING").when(k % 3 == 1, "MACHINERY").otherwise("FURNITURE")
    segment = F.when(k == 3, F.lit(None)).when(k == 4, "OTHER").otherwise(name)
    return table(spark, sf, "nation").select(segment.alias("segment"), k.cast("double").alias("amount"), "n_name")


for _how, _sql in (("left", "LEFT"), ("right", "RIGHT"), ("inner", "INNER"), ("outer", "FULL")):
    _statement = f"""SELECT c_custkey, coalesce(l.segment, r.segment) AS segment, l.amount AS amount, r.amount AS amount_r, n_name
        FROM {_LEFT_SQL} l {_sql} JOIN {_RIGHT_SQL} r ON l.segment IS NOT DISTINCT FROM r.segment"""
    add(
        f"join_{_how}",
        lambda s, sf, how=_how: joins.join(_left(s, sf), _right(s, sf), "segment", "segment", how),
        _statement,
    )
    if _how != "inner":
        add(
            f"join_{_how}_skewed",
            lambda s, sf, how=_how: joins.join(_left(s, sf), _right(s, sf), "segment", "segment", how, skewed=True),
            _statement,
        )
        add(
            f"join_{_how}_hot",
            lambda s, sf, how=_how: joins.join(_left(s, sf), _right(s, sf), "segment", "segment", how, hot_rows=20),
            _statement,
        )


@query(
    "join_two_keys",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, p_size, l_quantity FROM lineitem
       JOIN part ON l_partkey = p_partkey AND CAST(l_quantity AS INTEGER) = p_size""",
)
def _two_keys(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("size", F.col("l_quantity").cast("int"))
    out = joins.join(lines, table(spark, sf, "part"), ["l_partkey", "size"], ["p_partkey", "p_size"], "inner")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "p_size", "l_quantity")


@query(
    "join_different_key_names",
    """SELECT o_orderkey, o_custkey, c_custkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
)
def _key_names(spark, sf):
    right = table(spark, sf, "customer").select("c_custkey", "c_name")
    return joins.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), right, "o_custkey", "c_custkey")


@query("join_semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _semi(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 400000")
    return joins.semi(table(spark, sf, "customer"), big, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query("join_anti", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def _anti(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 400000")
    return joins.anti(table(spark, sf, "customer"), big, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query(
    "join_group_totals_back",
    f"""WITH l AS (SELECT * FROM {LEDGER_SQL}), g AS (SELECT voucher, count(*) AS n, sum(price) AS total FROM l GROUP BY 1)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n AS group_rows, round(total, 2) AS group_total
        FROM l JOIN g ON l.voucher IS NOT DISTINCT FROM g.voucher""",
)
def _totals_back(spark, sf):
    out = agg.with_group_totals(ledger(spark, sf), ["voucher"], {"group_rows": ("size", None), "group_total": ("sum", "price")})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "group_rows", rounded("group_total", 2))


# -- group-by ----------------------------------------------------------------------------

_SPECS = [
    ("balance", "size", "rows_all"),
    ("balance", "row_count", "rows_again"),
    ("segment", "count", "known_segments"),
    ("segment", "nunique", "segments"),
    ("balance", "sum", "total"),
    ("balance", "mean", "mean"),
    ("balance", "min", "low"),
    ("balance", "max", "high"),
    ("balance", "std", "spread"),
    ("balance", "var", "variance"),
    ("segment", "first", "first_segment"),
    ("segment", "last", "last_segment"),
    ("balance", "median", "middle"),
    ("balance", "p25", "quarter"),
    ("balance", "p75", "three_quarters"),
]


@query(
    "groupby_all_aggregates",
    f"""SELECT c_nationkey % 7 AS bucket, count(*) AS rows_all, count(*) AS rows_again, count(segment) AS known_segments,
        count(DISTINCT segment) AS segments, round(coalesce(sum(balance), 0), 4) AS total, round(avg(balance), 6) AS mean,
        min(balance) AS low, max(balance) AS high, round(stddev_pop(balance), 6) AS spread, round(var_pop(balance), 3) AS variance,
        arg_min(segment, c_custkey) FILTER (segment IS NOT NULL) AS first_segment,
        arg_max(segment, c_custkey) FILTER (segment IS NOT NULL) AS last_segment,
        round(quantile_cont(balance, 0.5), 6) AS middle, round(quantile_cont(balance, 0.25), 6) AS quarter,
        round(quantile_cont(balance, 0.75), 6) AS three_quarters FROM {ACCOUNTS_SQL} GROUP BY 1""",
)
def _groupby(spark, sf):
    df = accounts(spark, sf).withColumn("bucket", F.col("c_nationkey") % 7)
    out = agg.group_by(df, ["bucket"], _SPECS, order_by=["c_custkey"])
    digits = {"total": 4, "mean": 6, "spread": 6, "variance": 3, "middle": 6, "quarter": 6, "three_quarters": 6}
    return out.select(*[rounded(n, digits[n]) if n in digits else n for n in out.columns])


@query(
    "groupby_null_keys",
    f"""SELECT segment, c_nationkey, count(*) AS n, round(coalesce(sum(balance), 0), 4) AS total FROM {ACCOUNTS_SQL} GROUP BY 1, 2""",
)
def _groupby_nulls(spark, sf):
    out = agg.group_by(accounts(spark, sf), ["segment", "c_nationkey"], [(None, "size", "n"), ("balance", "sum", "total")])
    return out.withColumn("total", F.round("total", 4))


@query(
    "groupby_quantiles",
    """SELECT l_returnflag, l_linestatus, quantile_cont(l_quantity, 0.5) AS middle, round(quantile_cont(l_extendedprice, 0.25), 4) AS quarter,
       round(quantile_cont(l_extendedprice, 0.75), 4) AS three_quarters FROM lineitem GROUP BY 1, 2""",
)
def _groupby_quantiles(spark, sf):
    specs = [("l_quantity", "median", "middle"), ("l_extendedprice", "p25", "quarter"), ("l_extendedprice", "p75", "three_quarters")]
    out = agg.group_by(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], specs)
    return out.withColumns({"quarter": F.round("quarter", 4), "three_quarters": F.round("three_quarters", 4)})


@query(
    "reduce_column",
    f"""SELECT round(sum(balance), 4) AS sum, round(avg(balance), 6) AS average, min(balance) AS min, max(balance) AS max,
        count(*) AS count, round(stddev_pop(balance), 6) AS stdev, round(quantile_cont(balance, 0.5), 6) AS median FROM {ACCOUNTS_SQL}""",
)
def _reduce(spark, sf):
    out = agg.reduce_column(accounts(spark, sf), "balance")
    digits = {"sum": 4, "average": 6, "stdev": 6, "median": 6}
    return out.select(*[rounded(n, digits[n]) if n in digits else n for n in out.columns])


@query("count_if", "SELECT count(*) AS count_if FROM orders WHERE o_orderpriority = '1-URGENT'")
def _count_if(spark, sf):
    return agg.count_if(table(spark, sf, "orders"), "o_orderpriority", "1-URGENT")


@query("unique_values", "SELECT DISTINCT l_quantity FROM lineitem")
def _unique(spark, sf):
    return agg.unique_values(table(spark, sf, "lineitem"), "l_quantity")


@query("drop_missing", f"SELECT * FROM {ACCOUNTS_SQL} WHERE balance IS NOT NULL AND segment <> ''")
def _drop_missing(spark, sf):
    return agg.drop_missing(accounts(spark, sf))


@query("drop_missing_in_column", f"SELECT * FROM {ACCOUNTS_SQL} WHERE segment <> ''")
def _drop_missing_column(spark, sf):
    return agg.drop_missing(accounts(spark, sf), "segment")


@query("sort_values", f"SELECT c_custkey, balance FROM {ACCOUNTS_SQL}")
def _sort(spark, sf):
    return agg.sort_values(accounts(spark, sf).select("c_custkey", "balance"), "balance", ascending=False)


# -- appends -----------------------------------------------------------------------------


@query(
    "append_by_name",
    """SELECT c_acctbal AS balance, c_name AS name, c_mktsegment AS segment, 0 AS size, CAST(c_custkey AS VARCHAR) AS code FROM customer
       UNION ALL SELECT s_acctbal, s_name, '', 0, CAST(s_suppkey AS VARCHAR) FROM supplier
       UNION ALL SELECT p_retailprice, p_name, '', p_size, p_brand FROM part""",
)
def _append(spark, sf):
    c, s, p = (table(spark, sf, n) for n in ("customer", "supplier", "part"))
    frames = [
        c.selectExpr("c_acctbal AS balance", "c_name AS name", "c_mktsegment AS segment", "c_custkey AS code"),
        s.selectExpr("s_name AS name", "s_acctbal AS balance", "s_suppkey AS code"),
        p.selectExpr("p_size AS size", "p_name AS name", "p_retailprice AS balance", "p_brand AS code"),
    ]
    return append(frames)


# -- preview -----------------------------------------------------------------------------


@query("preview_column_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'heitü') AND contains(lang, 'de')")
def _column_search(spark, sf):
    return preview.search(table(spark, sf, "documents"), {"text": " HEITÜ ", "lang": "DE", "source": "  "}).select("doc_id")


@query(
    "preview_global_search",
    """SELECT doc_id FROM documents WHERE contains(lower(text), 'src1') OR contains(lower(source), 'src1')
       OR contains(CAST(doc_id AS VARCHAR), 'src1') OR contains(lang, 'src1') OR contains(CAST(n_chars AS VARCHAR), 'src1')""",
)
def _global_search(spark, sf):
    return preview.search(table(spark, sf, "documents"), anywhere="SRC1").select("doc_id")


@query(
    "preview_smart_sort_page",
    """SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS dated FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100""",
)
def _sorted_page(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yyyy").alias("dated"))
    rows, _ = preview.page(df, page=2, per=50, sort_by="dated", ascending=False, order_by=["o_orderkey"])
    return rows


@query(
    "preview_numeric_text_page",
    """SELECT p_partkey, CAST(p_retailprice AS VARCHAR) AS price FROM part ORDER BY p_retailprice, p_partkey LIMIT 25""",
)
def _numeric_page(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").cast("string").alias("price"))
    rows, _ = preview.page(df, per=25, sort_by="price", order_by=["p_partkey"])
    return rows


@query("preview_total", "SELECT count(*) AS total FROM part WHERE contains(lower(p_name), 'gear')")
def _total(spark, sf):
    _, total = preview.page(table(spark, sf, "part"), filters={"p_name": "gear"}, order_by=["p_partkey"])
    return total


@query(
    "preview_deep_page",
    """SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem ORDER BY l_returnflag DESC, l_orderkey, l_linenumber
       LIMIT 100 OFFSET (SELECT (count(*) // 100 - 1) * 100 FROM lineitem)""",
)
def _deep_page(spark, sf):
    """The last full page of the line items, by a key that three values share."""
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    rows, _ = preview.page(df, page=df.count() // 100 - 1, per=100, sort_by="l_returnflag", ascending=False, order_by=["l_orderkey", "l_linenumber"])
    return rows
