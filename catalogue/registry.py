"""Registration of queries and small shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = sql


def query(name: str, sql: str | None = None):
    def register(build):
        add(name, build, sql)
        return build

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- derived inputs: the tables hold no nulls and no messy text, so queries make some --------


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with a nullable balance and a nullable, partly empty segment."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        "c_custkey",
        "c_nationkey",
        F.when(k % 7 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.lit("")).otherwise(F.col("c_mktsegment")).alias("segment"),
    )


ACCOUNTS_SQL = """(SELECT c_custkey, c_nationkey,
  CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 5 = 1 THEN '' ELSE c_mktsegment END AS segment
  FROM customer)"""


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as journal entries: account codes, debit and credit sides, a nullable voucher."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    code = F.when(flag == "A", "600").when(flag == "R", "100").otherwise("999")
    counter = F.when(F.col("l_linestatus") == "F", "120").otherwise("900")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        F.col("l_extendedprice").alias("price"),
        F.when(F.col("l_orderkey") % 97 != 0, F.col("l_orderkey")).alias("voucher"),
        F.concat(code, F.lit("."), line.cast("string")).alias("account"),
        F.concat(counter, F.lit("."), (F.col("l_suppkey") % 10).cast("string")).alias("counter"),
        F.when(flag == "A", F.col("l_extendedprice")).alias("debit"),
        F.when(flag != "A", F.col("l_extendedprice")).alias("credit"),
    )


LEDGER_SQL = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice AS price,
  CASE WHEN l_orderkey % 97 <> 0 THEN l_orderkey END AS voucher,
  CASE l_returnflag WHEN 'A' THEN '600' WHEN 'R' THEN '100' ELSE '999' END || '.' || CAST(l_linenumber AS VARCHAR) AS account,
  CASE l_linestatus WHEN 'F' THEN '120' ELSE '900' END || '.' || CAST(l_suppkey % 10 AS VARCHAR) AS counter,
  CASE WHEN l_returnflag = 'A' THEN l_extendedprice END AS debit,
  CASE WHEN l_returnflag <> 'A' THEN l_extendedprice END AS credit
  FROM lineitem)"""

LEDGER_ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as postings with a creator, an approver, a description and a document number."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        "o_orderdate",
        "o_orderpriority",
        F.concat(F.lit("CORP\\U"), (k % 7).cast("string")).alias("creator"),
        F.concat(F.lit("u"), (F.col("o_custkey") % 7).cast("string"), F.lit("@corp.example")).alias("approver"),
        F.when(k % 4 == 0, "abc").when(k % 4 == 1, "Manuel kayıt").when(k % 4 == 2, "AÇILIŞ fişi")
        .otherwise("Devir işlemi - açık").alias("note"),
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit("D"), F.floor(k / 2).cast("string"))).alias("doc"),
        F.when(k % 3 == 0, "admin").when(k % 3 == 1, "Ayşe").otherwise("svc_system").alias("person"),
    )


POSTINGS_SQL = """(SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority,
  'CORP\\U' || CAST(o_orderkey % 7 AS VARCHAR) AS creator,
  'u' || CAST(o_custkey % 7 AS VARCHAR) || '@corp.example' AS approver,
  CASE o_orderkey % 4 WHEN 0 THEN 'abc' WHEN 1 THEN 'Manuel kayıt' WHEN 2 THEN 'AÇILIŞ fişi' ELSE 'Devir işlemi - açık' END AS note,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 'D' || CAST(o_orderkey // 2 AS VARCHAR) END AS doc,
  CASE o_orderkey % 3 WHEN 0 THEN 'admin' WHEN 1 THEN 'Ayşe' ELSE 'svc_system' END AS person
  FROM orders)"""


def rounded(column: str, digits: int = 6):
    """Rounded double under its own name, for results whose last digits depend on addition order."""
    return F.round(F.col(f"`{column}`"), digits).alias(column)
