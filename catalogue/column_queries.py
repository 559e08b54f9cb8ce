"""Coercion, column tools, loading and saving."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalogue.registry import add, ACCOUNTS_SQL, accounts, query, table
from ledgerscan.functions import Formula
from ledgerscan.functions import coerce as c
from ledgerscan.operators import columns as cols
from ledgerscan.plans.tables import shared_folder
from ledgerscan.sources import fill_defaults, read_any, read_csv, read_parquet, save, type_labels, value_index, write
from ledgerscan.sources.schema import clean_columns


def _folder(spark, kind: str) -> str:
    return f"{shared_folder(spark)}/ledgerscan/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


# -- coercion ----------------------------------------------------------------------------


def _messy_numbers(spark, sf):
    x, k = F.col("c_acctbal"), F.col("c_custkey") % 7
    plain = x.cast("string")
    size = F.translate(F.abs(x).cast("string"), ".", ",")
    turkish = F.translate(F.format_number(F.abs(x), 2), ",.", ".,")
    messy = (
        F.when(k == 0, plain)
        .when(k == 1, F.concat(F.lit(" ("), size, F.lit(") ")))
        .when(k == 2, F.concat(turkish, F.lit(" TL")))
        .when(k == 3, F.concat(F.format_number(F.abs(x), 2), F.lit(" USD")))
        .when(k == 4, F.concat(plain, F.lit("%")))
        .when(k == 5, F.lit("bilinmiyor"))
    )
    return table(spark, sf, "customer").select("c_custkey", messy.alias("raw"))


@query(
    "coerce_number_text",
    """SELECT c_custkey, round(CASE c_custkey % 7 WHEN 0 THEN c_acctbal WHEN 1 THEN -abs(c_acctbal) WHEN 2 THEN abs(c_acctbal)
       WHEN 3 THEN abs(c_acctbal) WHEN 4 THEN c_acctbal / 100 END, 6) AS amount FROM customer""",
)
def _coerce_number(spark, sf):
    return _messy_numbers(spark, sf).select("c_custkey", F.round(c.number_from_text("raw"), 6).alias("amount"))


@query(
    "coerce_date_text",
    """SELECT o_orderkey, CASE o_orderkey % 6
         WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 14 HOUR + INTERVAL 5 MINUTE
         WHEN 2 THEN CASE WHEN day(o_orderdate) > 12 THEN o_orderdate
                     ELSE make_timestamp(year(o_orderdate), day(o_orderdate), month(o_orderdate), 0, 0, 0) END
         WHEN 3 THEN o_orderdate WHEN 4 THEN o_orderdate END AS read_date FROM orders""",
)
def _coerce_date(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    raw = (
        F.when(k == 0, F.date_format(d, "dd.MM.yyyy"))
        .when(k == 1, F.concat(F.date_format(d, "yyyy-M-d"), F.lit(" 14:05:00")))
        .when(k == 2, F.date_format(d, "MM/dd/yyyy"))
        .when(k == 3, F.date_diff(d, F.lit("1899-12-30").cast("date")).cast("string"))
        .when(k == 4, F.date_format(d, "yyyyMMdd"))
        .otherwise(F.lit("31.02.2026"))
    )
    return table(spark, sf, "orders").select("o_orderkey", c.timestamp_from_text(raw).alias("read_date"))


@query(
    "coerce_date_words",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 6 THEN o_orderdate + INTERVAL 1 MINUTE * (CASE o_orderkey % 7 WHEN 4 THEN 0
         ELSE (o_orderkey * 37) % 1440 END) END AS read_date FROM orders""",
)
def _coerce_date_words(spark, sf):
    k = F.col("o_orderkey") % 7
    at = F.timestamp_add("MINUTE", (F.col("o_orderkey") * 37 % 1440).cast("int"), F.col("o_orderdate").cast("timestamp_ntz"))
    layouts = ["MMMM d, yyyy h:mm a", "d MMM yyyy HH:mm", "yyyyMMdd HHmm", "yyyy-MM-dd hh:mm:ss a", "d-MMM-yyyy", "EEEE, MMM d yyyy h:mm a"]
    raw = F.coalesce(*[F.when(k == i, F.date_format(at, layout)) for i, layout in enumerate(layouts)], F.lit("15 Foo 2026 10:00"))
    return table(spark, sf, "orders").select("o_orderkey", c.timestamp_from_text(raw).alias("read_date"))


@query(
    "coerce_simple_number",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS amount FROM customer""",
)
def _simple_number(spark, sf):
    x, k = F.col("c_acctbal").cast("string"), F.col("c_custkey") % 3
    raw = F.when(k == 0, F.concat(x, F.lit(" TL"))).when(k == 1, F.translate(x, ".", ",")).otherwise(x)
    return table(spark, sf, "customer").select("c_custkey", c.simple_number(raw).alias("amount"))


@query(
    "coerce_normalized_text",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'sisli oguz' ELSE 'cigdem urun' END AS folded FROM orders""",
)
def _normalized(spark, sf):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.lit("  ŞİŞLİ Oğuz\t")).otherwise(F.lit("Çiğdem ÜRÜN "))
    return table(spark, sf, "orders").select("o_orderkey", c.normalized(raw, fold=True).alias("folded"))


# -- column tools ------------------------------------------------------------------------


@query("column_drop", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _drop(spark, sf):
    return cols.drop(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment", "not_there"])


@query("column_rename", "SELECT s_suppkey AS id, s_name AS supplier, s_nationkey, s_acctbal FROM supplier")
def _rename(spark, sf):
    return cols.rename(table(spark, sf, "supplier"), {"s_suppkey": "id", "s_name": "supplier"})


@query("column_add_constant", "SELECT *, 'TRY' AS currency FROM supplier")
def _constant(spark, sf):
    return cols.add_constant(table(spark, sf, "supplier"), "currency", "TRY")


@query(
    "column_formula",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       round(l_extendedprice * (1 - l_discount) + l_tax, 6) AS net FROM lineitem""",
)
def _formula(spark, sf):
    df = table(spark, sf, "lineitem")
    f = Formula(df)
    out = cols.with_formula(df, "net", F.round(f.PRODUCT("l_extendedprice", 1 - f.NUM("l_discount")) + f.NUM("l_tax"), 6))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "net")


@query(
    "column_formula_sql",
    """SELECT c_custkey, round(CASE c_custkey % 7 WHEN 0 THEN c_acctbal WHEN 1 THEN -abs(c_acctbal) WHEN 2 THEN abs(c_acctbal)
       WHEN 3 THEN abs(c_acctbal) WHEN 4 THEN c_acctbal / 100 END * 2 + 1, 6) AS doubled FROM customer""",
)
def _formula_sql(spark, sf):
    df = _messy_numbers(spark, sf).withColumnRenamed("raw", "tutar (TL)")
    return cols.with_formula(df, "doubled", "round(tutar_TL * 2 + 1, 6)").select("c_custkey", "doubled")


@query(
    "column_fillna",
    f"""SELECT c_custkey, c_nationkey, coalesce(balance, -1) AS balance, coalesce(nullif(segment, ''), 'none') AS segment
        FROM {ACCOUNTS_SQL}""",
)
def _fillna(spark, sf):
    df = cols.fillna(accounts(spark, sf), ["balance"], "-1")
    return cols.fillna(df, ["segment"], "none")


@query(
    "column_typecast",
    """SELECT o_orderkey, o_totalprice AS price, CAST(o_orderdate AS TIMESTAMP) AS dated, CAST(o_custkey AS VARCHAR) AS customer
       FROM orders""",
)
def _typecast(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey",
        F.translate(F.col("o_totalprice").cast("string"), ".", ",").alias("price"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("dated"),
        F.col("o_custkey").alias("customer"),
    )
    df = cols.typecast(df, ["price"], "numeric")
    return cols.typecast(cols.typecast(df, ["dated"], "datetime"), ["customer"], "string")


@query(
    "column_steps",
    f"""SELECT c_custkey, coalesce(balance, 0) AS filled_column, upper(coalesce(segment, '')) AS upper_column,
        c_nationkey + coalesce(balance, 0) AS total FROM {ACCOUNTS_SQL}""",
)
def _steps(spark, sf):
    steps = [
        {"formula_id": "pd_fillna", "params": {"column": "balance", "value": "0"}},
        {"formula_id": "pd_upper", "params": {"column": "segment"}},
        {"formula_id": "pd_sum", "params": {"columns": ["c_nationkey", "balance", "segment"]}},
    ]
    out = cols.run_steps(accounts(spark, sf), steps)
    return out.select("c_custkey", "filled_column", "upper_column", "total")


# -- loading and saving ------------------------------------------------------------------


@query("source_parquet", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def _parquet(spark, sf):
    return read_parquet(spark, f"{sf}/orders.parquet").filter("o_totalprice > 250000").select("o_orderkey", "o_totalprice")


@query(
    "source_csv",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name,
       CASE WHEN p_partkey % 10 = 1 THEN NULL ELSE CAST(p_retailprice AS VARCHAR) END AS price
       FROM part WHERE p_partkey % 10 <> 0""",
)
def _csv(spark, sf):
    """Every tenth line has a field too many, every other tenth one too few; each part has its header."""
    k = F.col("p_partkey")
    price = F.when(k % 10 != 1, F.col("p_retailprice").cast("string"))
    line = F.concat_ws(";", k.cast("string"), "p_name", price, F.when(k % 10 == 0, F.lit("extra")))
    path = _files(table(spark, sf, "part").select((k % 4).alias("part"), line.alias("value")), ["id;name;price"])
    return read_csv(spark, path + "/*", sep=";")


def _files(lines, heads: list[str], path: str | None = None) -> str:
    """A folder with a file of the lines of every ``part`` (0 to 3), each beginning with ``heads``."""
    spark = lines.sparkSession
    path = path or _folder(spark, "lines")
    first = F.posexplode(F.array(*[F.lit(h) for h in heads])).alias("at", "value")
    above = spark.range(4).select(F.col("id").alias("part"), first)
    both = lines.select("part", F.lit(len(heads)).alias("at"), "value").unionByName(above)
    both.repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(path)
    return path


@query(
    "source_csv_headers_per_file",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, 'say "' || c_name || '"' || chr(10) || ', it is' AS name, CAST(NULL AS VARCHAR) AS balance
       FROM customer WHERE c_custkey % 2 = 0
       UNION ALL SELECT CAST(c_custkey AS VARCHAR), c_name, CAST(c_acctbal AS VARCHAR) FROM customer WHERE c_custkey % 2 = 1""",
)
def _headers(spark, sf):
    """Even keys with line breaks, marks and commas inside quotes; odd ones in files with their columns in another order."""
    k, name = F.col("c_custkey"), F.col("c_name")
    spoken = F.concat(k.cast("string"), F.lit(',"say ""'), name, F.lit('""\n, it is"'))
    customers = table(spark, sf, "customer").withColumn("part", F.floor(k / 2) % 4)
    folder = _folder(spark, "headers")
    _files(customers.filter(k % 2 == 0).select("part", spoken.alias("value")), ["key,name"], f"{folder}/even")
    _files(customers.filter(k % 2 == 1).select("part", F.concat_ws(",", "c_acctbal", name, k).alias("value")), ["balance,name,key"], f"{folder}/odd")
    return read_csv(spark, folder + "/*/*")


def _charset_query(encoding: str, sample: str) -> None:
    def build(spark, sf):
        df = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(sample), "c_name", F.lit("\n"), "c_mktsegment").alias("Açıklama" if "1254" in encoding else "Größe"))
        path = write(df, _folder(spark, "charset"), "csv", encoding=encoding)
        return read_any(spark, path, "csv", encoding=encoding)

    column = "Açıklama" if "1254" in encoding else "Größe"
    add(
        f"source_sink_csv_{encoding.replace('-', '_')}",
        build,
        f"""SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, '{sample}' || c_name || chr(10) || c_mktsegment AS "{column}" FROM customer""",
    )


_charset_query("windows-1254", "Ğİşığı ÖÇÜ €“x” ")
_charset_query("windows-1252", "Ðþ ÿ ß €“x”™ ")


@query("source_sink_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, nullif(segment, '') AS segment, "
       f"CAST(coalesce(balance, 0) AS VARCHAR) AS balance FROM {ACCOUNTS_SQL}")  # fmt: skip
def _sink_csv(spark, sf):
    path = write(accounts(spark, sf).select("c_custkey", "segment", "balance"), _folder(spark, "csv"), "csv")
    return read_any(spark, path, "csv")


def _documents_back(kind):
    """Whole texts, with line breaks and blanks at both ends, written and read again."""

    def build(spark, sf):
        text = F.concat(F.lit("  "), "text", F.lit(' "end" ')).alias("text")
        df = table(spark, sf, "documents").select("doc_id", "lang", text)
        return read_any(spark, write(df, _folder(spark, kind), kind), kind)

    return build


for _kind in ("csv", "tsv", "txt"):
    add(
        f"source_sink_{_kind}_texts" if _kind == "csv" else f"source_sink_{_kind}",
        _documents_back(_kind),
        """SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, '  ' || text || ' "end" ' AS text FROM documents""",
    )


@query(
    "source_sink_json",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents""",
)
def _sink_json(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return read_any(spark, write(df, _folder(spark, "json"), "json"), "jsonl")


@query(
    "source_xml",
    """SELECT CAST(o_orderkey AS VARCHAR) AS "@id", o_orderpriority AS priority, CAST(o_totalprice AS VARCHAR) AS price FROM orders""",
)
def _xml(spark, sf):
    path = _folder(spark, "xml")
    df = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("@id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")
    )
    df.write.format("xml").option("rowTag", "entry").option("rootTag", "ledger").option("attributePrefix", "@").save(path)
    return read_any(spark, path, "xml", row_tag="entry").select("@id", "priority", "price")


@query(
    "sink_parquet_row_cap",
    "SELECT count(*) AS rows_written, true AS capped FROM orders",
)
def _row_cap(spark, sf):
    path = write(table(spark, sf, "orders"), _folder(spark, "capped"), "parquet", rows_per_file=1000)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).count()
    return per_file.agg(F.sum("count").alias("rows_written"), (F.max("count") <= 1000).alias("capped"))


@query(
    "sink_save_append",
    f"""SELECT c_custkey, coalesce(balance, 0) AS balance, coalesce(segment, '') AS segment, '' AS s_name FROM {ACCOUNTS_SQL}
        UNION ALL SELECT 0, s_acctbal, '', s_name FROM supplier""",
)
def _save(spark, sf):
    target = save(accounts(spark, sf).drop("c_nationkey"), "target_accounts")
    more = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), "s_name")
    save(more, "target_accounts", "append", append_to=target)
    return spark.table("target_accounts")


@query(
    "fill_defaults",
    f"""SELECT c_custkey, c_nationkey, coalesce(balance, 0) AS balance, coalesce(segment, '') AS segment,
        c_custkey % 3 = 0 AS flag, CASE WHEN c_custkey % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' END AS at
        FROM {ACCOUNTS_SQL}""",
)
def _fill(spark, sf):
    k = F.col("c_custkey")
    df = accounts(spark, sf).withColumns(
        {
            "balance": F.when(k % 14 == 0, F.lit(float("nan"))).when(k % 21 == 0, F.lit(float("inf"))).otherwise(F.col("balance")),
            "flag": F.when(k % 3 == 0, F.lit(True)),
            "at": F.when(k % 2 == 0, F.lit("2024-01-01").cast("timestamp_ntz")),
        }
    )
    return fill_defaults(df)


@query(
    "infer_types",
    """WITH cells AS (
         SELECT c_custkey, 'c_custkey' AS column_name, 1 AS number, 1 AS dated FROM customer
         UNION ALL SELECT c_custkey, 'raw', CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END,
           CASE WHEN c_custkey % 7 = 0 AND c_acctbal >= 1 THEN 1 ELSE 0 END FROM customer WHERE c_custkey % 7 <> 6
         UNION ALL SELECT c_custkey, 'price', 1, 0 FROM customer
         UNION ALL SELECT c_custkey, 'dated', 0, CASE WHEN c_custkey % 5 <> 0 THEN 1 ELSE 0 END FROM customer
         UNION ALL SELECT c_custkey, 'few', 0, 1 FROM customer WHERE c_custkey % 50 = 0
         UNION ALL SELECT c_custkey, 'near', CASE WHEN c_custkey % 20 < 3 THEN 0 ELSE 1 END, CASE WHEN c_custkey % 20 < 3 THEN 0 ELSE 1 END FROM customer
         UNION ALL SELECT c_custkey, 'seg', CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END, 0 FROM customer),
       placed AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY md5(c_custkey::VARCHAR)) AS place FROM cells),
       shares AS (SELECT column_name, avg(number) AS numbers, avg(dated) AS dates FROM placed WHERE place <= 500 GROUP BY 1)
       SELECT column_name, CASE WHEN numbers > 0.85 THEN 'numeric' WHEN dates > 0.7 THEN 'date' ELSE 'text' END AS label FROM shares
       UNION ALL SELECT 'empty', 'text'""",
)
def _infer(spark, sf):
    df = _messy_numbers(spark, sf).withColumns(
        {
            "price": F.concat(F.col("c_custkey").cast("string"), F.lit(",5")),
            "dated": F.when(F.col("c_custkey") % 5 != 0, F.lit("17.03.2024")).otherwise(F.lit("soon")),
            "empty": F.lit(None).cast("string"),
            "few": F.when(F.col("c_custkey") % 50 == 0, F.date_format(F.lit("2024-03-17").cast("date"), "d MMM yyyy")),
            "near": F.when(F.col("c_custkey") % 20 < 3, F.lit("n/a")).otherwise(F.lit("7")),
            "seg": F.when(F.col("c_custkey") % 2 == 0, F.lit("12")).otherwise(F.lit("twelve")),
        }
    )
    return type_labels(df, key=["c_custkey"])


@query(
    "value_index",
    """SELECT 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders GROUP BY 2
       UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders GROUP BY 2
       UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR) FROM orders GROUP BY 2
         HAVING (SELECT count(DISTINCT o_custkey) FROM orders) <= 2000""",
)
def _value_index(spark, sf):
    return value_index(table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"], 2000)


@query(
    "source_csv_header_row",
    """SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_totalprice AS VARCHAR) AS price, NULL::VARCHAR AS "Col_2" FROM orders""",
)
def _header_row(spark, sf):
    """Reports with a title line above their headers, which end in an unnamed column."""
    line = F.concat_ws(";", "o_orderkey", "o_totalprice").alias("value")
    path = _files(table(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("part"), line), ["Open orders", "key;price;"])
    return read_csv(spark, path + "/*", sep=";", header_row=1)


@query(
    "source_csv_skiprows",
    """SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name FROM customer""",
)
def _skip_rows(spark, sf):
    """Two lines of units below the header of every file are left out."""
    line = F.concat_ws(",", "c_custkey", "c_name").alias("value")
    path = _files(table(spark, sf, "customer").select((F.col("c_custkey") % 4).alias("part"), line), ["key,name", "number,text", "-,-"])
    return read_csv(spark, path + "/*", skiprows=2)


@query("clean_column_names", """SELECT s_suppkey AS "id", s_name AS "id_2", s_nationkey AS "Col_2", s_acctbal AS "x" FROM supplier""")
def _clean_names(spark, sf):
    return clean_columns(table(spark, sf, "supplier").toDF("id", " id", "  ", "x "))
