"""Manual filter operators, condition lists, condition trees and formula filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import ACCOUNTS_SQL, accounts, add, query, table
from ledgerscan.operators.predicates import Condition, where_conditions, where_formula, where_tree

AS_OF = "2024-01-17"

_SOURCES = {
    "accounts": (accounts, "c_custkey", ACCOUNTS_SQL),
    "documents": (lambda s, sf: table(s, sf, "documents"), "doc_id", "documents"),
    "events": (lambda s, sf: table(s, sf, "events"), "event_id", "events"),
    "orders": (lambda s, sf: table(s, sf, "orders"), "o_orderkey", "orders"),
}


def _operator(name: str, source: str, column: str, where: str, operator: str | None = None, **condition):
    load, key, relation = _SOURCES[source]
    cond = Condition(column, operator or name, **condition)

    def build(spark, sf):
        return where_conditions(load(spark, sf), [cond], order_by=[key], as_of=AS_OF).select(key, column)

    add(f"filter_{name}", build, f"SELECT {key}, {column} FROM {relation} WHERE {where}")


# text
_operator("contains", "accounts", "segment", "contains(lower(coalesce(segment,'')), 'build')", value="BUILD")
_operator("not_contains", "accounts", "segment", "NOT contains(lower(coalesce(segment,'')), 'build')", value="build")
_operator("equals", "accounts", "segment", "lower(coalesce(segment,'')) = 'machinery'", value="Machinery")
_operator("not_equals", "accounts", "segment", "lower(coalesce(segment,'')) <> 'machinery'", value="Machinery")
_operator("equals_numeric", "accounts", "c_nationkey", "c_nationkey = 7", operator="equals", value="7,0", dtype="numeric")
_operator(
    "not_equals_numeric", "accounts", "balance", "balance IS NOT NULL AND balance <> 2547.4",
    operator="not_equals", value="2.547,40", dtype="numeric",
)
_operator("starts", "accounts", "segment", "starts_with(segment, 'FUR')", value="FUR", case_sensitive=True)
_operator("ends", "accounts", "segment", "ends_with(lower(segment), 'ry')", value="RY")
_operator("regex", "documents", "text", "regexp_matches(text, 'ö[a-z]+heit', 'i')", value="Ö[a-z]+HEIT")
_operator("regex_not", "documents", "text", "NOT regexp_matches(text, 'ö[a-z]+heit', 'i')", value="Ö[a-z]+heit")
_operator("in", "accounts", "segment", "lower(segment) IN ('building', 'furniture')", values="Building; FURNITURE,building")
_operator("not_in", "accounts", "segment", "coalesce(lower(segment),'') NOT IN ('building', 'furniture')",
          values=["Building", "Furniture"])
_operator("is_empty", "accounts", "segment", "segment IS NULL OR segment = ''")
_operator("not_empty", "accounts", "segment", "segment IS NOT NULL AND segment <> ''")
_operator("len_eq", "accounts", "segment", "length(coalesce(segment,'')) = 9", value=9)
_operator("len_lt", "accounts", "segment", "length(coalesce(segment,'')) < 9", value=9)
_operator("len_gt", "documents", "text", "length(text) > 2000", value=2000)
_operator("duplicate", "accounts", "balance",
          "balance IS NULL OR balance IN (SELECT c_acctbal FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1 HAVING count(*) > 1)")
_operator("unique", "accounts", "balance",
          "balance IN (SELECT c_acctbal FROM customer WHERE c_custkey % 7 <> 0 GROUP BY 1 HAVING count(*) = 1)")

# numbers
_operator("gt", "accounts", "balance", "balance > 5000", value=5000)
_operator("gte", "accounts", "balance", "balance >= 2547.4", value="2547,4")
_operator("lt", "accounts", "balance", "balance < 0", value=0)
_operator("lte", "accounts", "balance", "balance <= -500", value="(500)")
_operator("between", "accounts", "balance", "balance BETWEEN 100 AND 900", value=900, value2=100)
_operator("not_between", "accounts", "balance", "balance IS NULL OR balance NOT BETWEEN 100 AND 900", value=100, value2=900)
_operator("num_in", "accounts", "c_nationkey", "c_nationkey IN (1, 3, 5)", values="1;3;5.0;x")
_operator("num_not_in", "accounts", "balance", "balance IS NULL OR balance NOT IN (2547.4, 1863.84)", values="2547.4;1863.84")
_operator("zero", "accounts", "c_nationkey", "c_nationkey = 0")
_operator("non_zero", "accounts", "c_nationkey", "c_nationkey <> 0")
_operator("positive", "accounts", "balance", "balance > 0")
_operator("negative", "accounts", "balance", "balance < 0")
_operator("top_n", "accounts", "balance",
          "c_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 12)",
          value=12)
_operator("bottom_n", "accounts", "c_nationkey",
          "c_custkey IN (SELECT c_custkey FROM customer ORDER BY c_nationkey, c_custkey LIMIT 15)", value=15)
_operator("random_n", "accounts", "balance",
          "c_custkey IN (SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || '|42'), c_custkey LIMIT 20)",
          value=20)

# dates; the reference day is fixed
_operator("date_eq", "events", "ts", "CAST(ts AS DATE) = DATE '2024-01-05'", value="05.01.2024")
_operator("date_equals", "events", "ts", "CAST(ts AS DATE) = DATE '2024-01-06'", value="2024-01-06 23:00")
_operator("date_before", "events", "ts", "ts < TIMESTAMP '2024-01-03 12:30:00'", value="2024-01-03 12:30")
_operator("date_after", "events", "ts", "ts > TIMESTAMP '2024-01-28 00:00:00'", value="28/01/2024")
_operator("date_on_or_after", "orders", "o_orderdate", "o_orderdate >= TIMESTAMP '2001-07-01'", value="01.07.2001")
_operator("date_on_or_before", "orders", "o_orderdate", "o_orderdate <= TIMESTAMP '1995-02-01'", value="1995/02/01")
_operator("month", "orders", "o_orderdate", "month(o_orderdate) = 2", value=2)
_operator("year", "orders", "o_orderdate", "year(o_orderdate) = 1999", value="1999")
_operator("date_between", "events", "ts", "CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12'",
          value="12.01.2024", value2="10.01.2024")
_operator("date_between_with_time", "events", "ts",
          "ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-12 18:00:00'", operator="date_between",
          value="10.01.2024 06:00", value2="12.01.2024 18:00", options={"ignore_time": False})
_operator("today", "events", "ts", "CAST(ts AS DATE) = DATE '2024-01-17'")
_operator("yesterday", "events", "ts", "CAST(ts AS DATE) = DATE '2024-01-16'")
_operator("this_week", "events", "ts", "ts BETWEEN TIMESTAMP '2024-01-15 00:00:00' AND TIMESTAMP '2024-01-21 23:59:59'")
_operator("last_week", "events", "ts", "ts BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-14 23:59:59'")
_operator("this_month", "events", "ts", "year(ts) = 2024 AND month(ts) = 1")
_operator("this_year", "events", "ts", "year(ts) = 2024")
_operator("last_n_days", "events", "ts", "ts BETWEEN TIMESTAMP '2024-01-14' AND TIMESTAMP '2024-01-18'", value=3)
_operator("first_n_days", "events", "ts",
          "ts BETWEEN (SELECT min(ts) FROM events) AND (SELECT min(ts) FROM events) + INTERVAL 3 DAY", value=4)
_operator("weekday", "events", "ts", "isodow(ts) = 3", value="Çarşamba")
_operator("weekend", "events", "ts", "isodow(ts) IN (6, 7)")


def _past(name: str, as_of: str, where: str):
    def build(spark, sf):
        cond = Condition("o_orderdate", name)
        return where_conditions(table(spark, sf, "orders"), [cond], as_of=as_of).select("o_orderkey", "o_orderdate")

    add(f"filter_{name}", build, f"SELECT o_orderkey, o_orderdate FROM orders WHERE {where}")


_past("last_month", "15.01.1999", "year(o_orderdate) = 1998 AND month(o_orderdate) = 12")
_past("last_year", "1999-06-01", "year(o_orderdate) = 1998")


def _answers(spark, sf):
    k = F.col("event_id") % 6
    answer = (
        F.when(k == 0, " Evet ").when(k == 1, "TRUE").when(k == 2, "0").when(k == 3, "Hayır").when(k == 4, "maybe")
    )
    return table(spark, sf, "events").select("event_id", answer.alias("answer"))


_ANSWERS_SQL = """(SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' Evet ' WHEN 1 THEN 'TRUE' WHEN 2 THEN '0'
  WHEN 3 THEN 'Hayır' WHEN 4 THEN 'maybe' END AS answer FROM events)"""

add(
    "filter_is_true",
    lambda s, sf: where_conditions(_answers(s, sf), [Condition("answer", "is_true")]),
    f"SELECT * FROM {_ANSWERS_SQL} WHERE event_id % 6 IN (0, 1)",
)
add(
    "filter_is_false",
    lambda s, sf: where_conditions(_answers(s, sf), [Condition("answer", "is_false")]),
    f"SELECT * FROM {_ANSWERS_SQL} WHERE event_id % 6 IN (2, 3)",
)


@query(
    "filter_conditions_and",
    f"SELECT * FROM {ACCOUNTS_SQL} WHERE balance > 1000 AND coalesce(segment,'') = ''",
)
def _and_list(spark, sf):
    return where_conditions(
        accounts(spark, sf),
        [Condition("balance", "gt", 1000), Condition("segment", "is_empty"), Condition("balance", "zero", enabled=False)],
    )


@query(
    "filter_conditions_or",
    f"SELECT * FROM {ACCOUNTS_SQL} WHERE balance < 0 OR segment = 'BUILDING'",
)
def _or_list(spark, sf):
    conditions = [Condition("balance", "negative"), Condition("segment", "equals", "building")]
    return where_conditions(accounts(spark, sf), conditions, logic="or")


@query(
    "filter_tree",
    f"""SELECT * FROM {ACCOUNTS_SQL} WHERE (balance < 0 OR (starts_with(segment, 'M') AND c_nationkey > 10))
        AND c_nationkey <> 3 AND segment <> ''
        AND segment IN (SELECT segment FROM {ACCOUNTS_SQL} GROUP BY 1 HAVING count(*) > 1)""",
)
def _tree(spark, sf):
    node = {
        "logic": "and",
        "children": [
            {
                "logic": "or",
                "children": [
                    Condition("balance", "negative"),
                    {"children": [Condition("segment", "starts", "m"), Condition("c_nationkey", "gt", 10)]},
                ],
            },
            Condition("c_nationkey", "not_equals", 3, dtype="numeric"),
            Condition("segment", "duplicate"),
            Condition("segment", "regex", "^."),
            {"logic": "or", "children": []},
        ],
    }
    return where_tree(accounts(spark, sf), node)


@query("filter_formula", f"SELECT * FROM {ACCOUNTS_SQL} WHERE balance > 100 * c_nationkey AND segment IS NOT NULL")
def _formula(spark, sf):
    return where_formula(accounts(spark, sf), "balance > 100 * c_nationkey AND segment IS NOT NULL")


def _half(op, sql):
    def build(spark, sf):
        df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
        return where_conditions(df, [Condition("l_quantity", op, df.count() // 2)], order_by=["l_orderkey", "l_linenumber"])

    add(f"filter_{op}_half", build, f"""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
        QUALIFY row_number() OVER (ORDER BY {sql}) <= (SELECT count(*) // 2 FROM lineitem)""")  # fmt: skip


# half of all rows; fifty quantities share the rows, so the bound lies among thousands of ties
_half("top_n", "l_quantity DESC, l_orderkey, l_linenumber")
_half("bottom_n", "l_quantity, l_orderkey, l_linenumber")
_half("random_n", "md5(concat_ws('|', l_orderkey, l_linenumber, '42')), l_orderkey, l_linenumber")
