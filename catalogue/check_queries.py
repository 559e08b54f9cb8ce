"""Audit checks with their helper columns, column methods, chains, scopes and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import (
    ACCOUNTS_SQL,
    LEDGER_ROW,
    LEDGER_SQL,
    POSTINGS_SQL,
    accounts,
    add,
    ledger,
    postings,
    query,
    rounded,
    table,
)
from ledgerscan.operators.checks import chain_and, chain_or, result_counts, result_sample, run_check

ROW_HELPERS = ["matched_column", "matched_value", "match_reason", "check_name", "check_result"]

_SOURCES = {
    "accounts": (accounts, ["c_custkey"], ACCOUNTS_SQL),
    "postings": (postings, ["o_orderkey"], POSTINGS_SQL),
    "ledger": (ledger, LEDGER_ROW, LEDGER_SQL),
    "events": (lambda s, sf: table(s, sf, "events"), ["event_id"], "events"),
    "documents": (lambda s, sf: table(s, sf, "documents"), ["doc_id"], "documents"),
    "parts": (lambda s, sf: table(s, sf, "part"), ["p_partkey"], "part"),
}


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def row_check(name, check, source, columns, tests, reason, match=None, method=None, **params):
    """A check on single rows. ``tests``: (label, SQL condition, SQL text of the value) per tested column."""
    load, keys, relation = _SOURCES[source]
    shown = f"Check {check}"

    def build(spark, sf):
        found = run_check(load(spark, sf), check, columns, method=method, name=shown, order_by=keys, as_of="2024-01-20",
                          **params)
        return found.select(*keys, *ROW_HELPERS)

    label = " ".join(f"WHEN {cond} THEN {_sql_text(col)}" for col, cond, _ in tests)
    value = " ".join(f"WHEN {cond} THEN coalesce(CAST({v} AS VARCHAR), '')" for _, cond, v in tests)
    anything = " OR ".join(f"coalesce({cond}, false)" for _, cond, _ in tests)
    sql = f"""SELECT {", ".join(keys)}, CASE {label} ELSE '' END AS matched_column,
      CASE {value} ELSE '' END AS matched_value, {_sql_text(reason)} AS match_reason,
      {_sql_text(shown)} AS check_name, CASE WHEN {anything} THEN 'Eşleşti' ELSE 'Kontrol edildi' END AS check_result
      FROM {relation} WHERE {match or anything}"""
    add(name, build, sql)


def plain_check(name, check, source, columns, helpers, sql, method=None, order_by=None, rounding=(), **params):
    """Any other check: the row key and the given helper columns."""
    load, keys, _ = _SOURCES[source]

    def build(spark, sf):
        found = run_check(load(spark, sf), check, columns, method=method, name=f"Check {check}", order_by=order_by or (),
                          **params)
        return found.select(*keys, *[rounded(h, rounding[h]) if h in rounding else h for h in helpers])

    add(name, build, sql)


# -- blanks ------------------------------------------------------------------------------

_BLANK = "lower(trim(coalesce({0},''))) IN ('', 'null', 'n/a', 'na', 'none', '.', '-', '/', '?', '***')"
_EMPTY_REASON = "Boş/dolu değer kontrolü"

row_check("check_empty", "empty", "accounts", ["segment", "balance"],
          [("segment", _BLANK.format("segment"), "segment"), ("balance", "balance IS NULL", "balance")], _EMPTY_REASON)
row_check("check_empty_all_columns", "empty", "accounts", ["segment", "balance"],
          [("segment", _BLANK.format("segment"), "segment"), ("balance", "balance IS NULL", "balance")], _EMPTY_REASON,
          match=f"{_BLANK.format('segment')} AND balance IS NULL", method="all")
row_check("check_empty_document", "empty_document", "postings", ["doc"], [("doc", "doc IS NULL", "doc")], _EMPTY_REASON)
row_check("check_empty_description", "empty_description", "postings", ["note"],
          [("note", "lower(note) = 'abc'", "note")], _EMPTY_REASON, invalid_values="ABC;xyz")
row_check("check_not_empty", "not_empty", "accounts", ["segment"],
          [("segment", f"NOT {_BLANK.format('segment')}", "segment")], _EMPTY_REASON,
          match="length(trim(segment)) >= 9", min_len=9)

# -- words -------------------------------------------------------------------------------

_WORDS = "Kelime listesi kontrolu"
row_check("check_contains_word", "contains_word", "parts", ["p_name", "p_type"],
          [("p_name", "regexp_matches(p_name, 'red|promo', 'i')", "p_name"),
           ("p_type", "regexp_matches(p_type, 'red|promo', 'i')", "p_type")], _WORDS, keywords="red\nPROMO")
row_check("check_not_contains_word", "not_contains_word", "parts", ["p_name"],
          [("p_name", "NOT regexp_matches(p_name, 'red|blue|hot', 'i')", "p_name")], _WORDS, keywords="red,blue,HOT")
row_check("check_manual_entries", "manual_entries", "postings", ["note"],
          [("note", "contains(lower(note), 'manuel')", "note")], _WORDS)
row_check("check_special_chars", "special_chars_description", "documents", ["text"],
          [("text", r"regexp_matches(text, '[^a-zA-Z0-9ığüşöçİĞÜŞÖÇ\s.,;:!?/\-]', 'i')", "text")],
          "Ozel karakter kontrolu")
row_check("check_suspicious_keywords", "suspicious_keywords", "postings", ["note", "person"],
          [("note", "o_orderkey % 4 = 1", "note"), ("person", "false", "person")], "Şüpheli anahtar kelime")
row_check("check_suspicious_keywords_own_list", "suspicious_keywords", "documents", ["text"],
          [("text", "regexp_matches(text, 'heitü|password|api_key', 'i')", "text")], "Şüpheli anahtar kelime",
          keywords="heitü,password,api_key")
row_check("check_generic_system_user", "generic_system_user", "postings", ["person"],
          [("person", "o_orderkey % 3 IN (0, 2)", "person")], "Generic/sistem kullanıcısı")
row_check("check_short_text", "short_text", "postings", ["note"], [("note", "length(note) < 5", "note")], "Kısa açıklama")
row_check("check_voucher_list", "voucher", "postings", ["doc"], [("doc", "doc IN ('D10', 'D77', 'D1200')", "doc")],
          "Check voucher liste kontrolü", values="d10;D77;D1200")
row_check("check_users_list", "users", "postings", ["person"], [("person", "person = 'Ayşe'", "person")],
          "Check users liste kontrolü", values=["ayşe"])
row_check("check_exclude_opening", "exclude_opening", "postings", ["note"],
          [("note", "o_orderkey % 4 IN (2, 3)", "note")], "Açılış/devir kaydı hariç tutuldu",
          match="o_orderkey % 4 NOT IN (2, 3)")

# -- amounts -----------------------------------------------------------------------------

row_check("check_amount_between", "amount_between", "postings", ["o_totalprice"],
          [("o_totalprice", "o_totalprice BETWEEN 1000 AND 20000", "o_totalprice")], "Tutar araligi",
          min_amount="1.000,00", max_amount=20000)
row_check("check_high_amount", "high_amount", "postings", ["o_totalprice"],
          [("o_totalprice", "o_totalprice >= 100000", "o_totalprice")], "Yuksek tutar")
row_check("check_negative", "negative", "accounts", ["balance"], [("balance", "balance < 0", "balance")], "Negatif tutar")
row_check("check_negative_threshold", "negative", "accounts", ["balance", "c_nationkey"],
          [("balance", "balance < 3", "balance"), ("c_nationkey", "c_nationkey < 3", "c_nationkey")], "Negatif tutar",
          threshold=3)
row_check("check_zero", "zero", "accounts", ["c_nationkey"], [("c_nationkey", "abs(c_nationkey) <= 1", "c_nationkey")],
          "Sıfır/tolerans kontrolü", tolerance=1)
row_check("check_round_amounts", "round_amounts", "parts", ["p_retailprice"],
          [("p_retailprice", "p_retailprice >= 950 AND abs(p_retailprice % 10) <= 1e-9", "p_retailprice")],
          "10 katı yuvarlak tutar", multiple=10, min_amount=950)
_EXTREME = "{0} IN (SELECT {0} FROM {1} WHERE {2} IS NOT NULL ORDER BY {2} {3}, {0} LIMIT {4})"
row_check("check_top_n", "top_n", "accounts", ["balance", "c_nationkey"],
          [("balance", _EXTREME.format("c_custkey", ACCOUNTS_SQL, "balance", "DESC", 10), "balance"),
           ("c_nationkey", _EXTREME.format("c_custkey", ACCOUNTS_SQL, "c_nationkey", "DESC", 10), "c_nationkey")],
          "Check top_n N=10")
row_check("check_bottom_n", "bottom_n", "accounts", ["balance"],
          [("balance", _EXTREME.format("c_custkey", ACCOUNTS_SQL, "balance", "ASC", 25), "balance")],
          "Check bottom_n N=25", n=25)
row_check("check_random_n", "random_n", "accounts", ["balance"],
          [("balance", "c_custkey IN (SELECT c_custkey FROM customer ORDER BY md5(CAST(c_custkey AS VARCHAR) || '|42') LIMIT 30)",
            "balance")], "Check random_n N=30", n=30)

# -- dates -------------------------------------------------------------------------------

row_check("check_date_range_outside", "date_range", "events", ["ts"],
          [("ts", "CAST(ts AS DATE) NOT BETWEEN DATE '2024-01-03' AND DATE '2024-01-28'", "ts")], "Tarih araligi",
          start_date="03.01.2024", end_date="28.01.2024", outside=True)
row_check("check_date_between", "date_between", "events", ["ts"],
          [("ts", "CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-05'", "ts")], "Belirli tarih aralığı",
          start_date="2024-01-03", end_date="2024-01-05")
row_check("check_date_set", "date_set", "postings", ["o_orderdate"],
          [("o_orderdate", "CAST(o_orderdate AS DATE) IN (DATE '1996-02-29', DATE '1998-10-03')", "o_orderdate")],
          "Tarih listesi", date_values="29.02.1996;1998-10-03;nonsense")
row_check("check_month_end", "month_end", "postings", ["o_orderdate"],
          [("o_orderdate", "CAST(o_orderdate AS DATE) = last_day(o_orderdate)", "o_orderdate")], "Ay sonu")
row_check("check_year_end", "year_end", "postings", ["o_orderdate"],
          [("o_orderdate", "month(o_orderdate) = 12 AND day(o_orderdate) = 31", "o_orderdate")], "Yil sonu")
row_check("check_period_end", "period_end", "events", ["ts"],
          [("ts", "ts BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-20'", "ts")], "Dönem sonu aralığı")
row_check("check_weekend", "weekend", "postings", ["o_orderdate"],
          [("o_orderdate", "isodow(o_orderdate) > 5", "o_orderdate")], "Hafta sonu tarih")
_LATE = "(hour(ts) * 60 + minute(ts) < 480 OR hour(ts) * 60 + minute(ts) > 1080)"
row_check("check_after_hours", "after_hours", "events", ["ts"], [("ts", f"{_LATE} OR isodow(ts) > 5", "ts")],
          "Mesai dışı kayıt")
row_check("check_after_hours_night_shift", "after_hours", "events", ["ts"],
          [("ts", "hour(ts) * 60 + minute(ts) BETWEEN 6 * 60 + 1 AND 22 * 60 - 1", "ts")], "Mesai dışı kayıt",
          work_start="22:00", work_end="06:00", weekend_as_after_hours=False)
row_check("check_after_hours_high_amount", "after_hours_high_amount", "events", [],
          [("ts", f"{_LATE} AND abs(value) >= 100", "ts"), ("value", f"{_LATE} AND abs(value) >= 100", "value")],
          "Mesai disi yuksek tutar", datetime_col="ts", amount_col="value", min_amount=100)

# -- accounts and people -----------------------------------------------------------------

_CODES = "Hesap kodu eşleşmesi"
row_check("check_account_codes", "account_codes", "ledger", ["account"],
          [("account", "starts_with(account, '600') OR starts_with(account, '999.1')", "account")], _CODES,
          include_accounts="600,999.1")
row_check("check_account_groups", "account_groups", "ledger", ["counter"],
          [("counter", "starts_with(counter, '12')", "counter")], _CODES, include_accounts="12")
row_check("check_account_prefix", "account_prefix", "ledger", ["account"],
          [("account", "starts_with(account, '10')", "account")], _CODES, values="109.1", prefix_len=2)
row_check("check_account_range", "account_range", "ledger", ["account", "counter"],
          [("account", "CAST(substr(account, 1, 3) AS INTEGER) BETWEEN 100 AND 130", "account"),
           ("counter", "CAST(substr(counter, 1, 3) AS INTEGER) BETWEEN 100 AND 130", "counter")],
          "Hesap kodu araligi", start_account=100, end_account=130)

_LEDGER_KEYS = ", ".join(LEDGER_ROW)
# The expected counter accounts of a revenue account.
_EXPECTED = [
    "100", "101", "102", "120", "121", "127", "150", "153", "157", "181", "281", "320", "380", "391", "480", "620",
    "646", "654", "689", "710", "712", "720", "721", "730", "731", "760", "770", "771", "800",
]


def _combo(check: str, main: list[str], expected: list[str], **params):
    main_sql = " OR ".join(f"starts_with(account, '{m}')" for m in main)
    expected_sql = " OR ".join(f"starts_with(counter, '{m}')" for m in expected)
    plain_check(
        f"check_{check}", check, "ledger", ["account", "counter"],
        ["check_name", "account_combo", "match_reason", "risk_level"],
        f"""SELECT {_LEDGER_KEYS}, 'Check {check}' AS check_name, account || ' / ' || counter AS account_combo,
            'Beklenen karşı hesap dışında çalışma' AS match_reason, 'Yüksek' AS risk_level
            FROM {LEDGER_SQL} WHERE ({main_sql}) AND NOT ({expected_sql})""", **params,
    )


_combo("revenue_counter_account", ["600", "601", "602", "610", "611"], _EXPECTED)
_combo("unusual_account_combo", ["100", "999"], ["120"], accounts="100,999", expected_accounts="120")
_combo("opex_counter_account", ["999"], _EXPECTED, main_accounts="999")
_combo("inventory_counter_account", ["100"], ["900.1", "900.2"], accounts="100", expected_accounts="900.1;900.2")
_combo("asset_account_control", ["100.1", "100.2"], ["120"], accounts=["100.1", "100.2"], expected_accounts=["120"])

plain_check(
    "check_rare_account_combo", "rare_account_combo", "postings", ["o_orderpriority", "doc"],
    ["check_name", "account_combo", "risk_level"],
    f"""WITH p AS (SELECT *, lower(o_orderpriority) || ' / ' || lower(coalesce(doc, '')) AS combo FROM {POSTINGS_SQL})
        SELECT o_orderkey, 'Check rare_account_combo' AS check_name, combo AS account_combo, 'Yüksek' AS risk_level
        FROM p WHERE combo IN (SELECT combo FROM p GROUP BY 1 HAVING count(*) <= 1)""",
)
plain_check(
    "check_creator_approver_same", "creator_approver_same", "postings", [], ["check_name", "check_result", "risk_level"],
    f"""SELECT o_orderkey, 'Check creator_approver_same' AS check_name, 'Olusturan ve onaylayan ayni' AS check_result,
        'Yüksek' AS risk_level FROM {POSTINGS_SQL} WHERE o_orderkey % 7 = o_custkey % 7""",
    creator_col="creator", approver_col="approver",
)
plain_check(
    "check_compare_columns", "contains_word", "postings", ["creator", "approver"], ["check_name", "check_result"],
    f"""SELECT o_orderkey, 'Check contains_word' AS check_name, 'Kolonlar karşılaştırıldı' AS check_result
        FROM {POSTINGS_SQL} WHERE lower(creator) <> lower(approver)""",
    method="compare_columns",
)



@query(
    "check_compare_columns_equal",
    f"""SELECT c_custkey, 'Kolonlar karşılaştırıldı' AS check_result FROM {ACCOUNTS_SQL}
        WHERE c_nationkey % 3 = 0 OR coalesce(segment, '') = ''""",
)
def _compare_equal(spark, sf):
    copy = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit(" "), F.lower("segment"))).otherwise(F.lit(""))
    df = accounts(spark, sf).withColumn("copied", copy)
    found = run_check(df, "empty", ["segment", "copied"], method="compare_columns", comparison="equal")
    return found.select("c_custkey", "check_result")


# -- column methods ----------------------------------------------------------------------

row_check("check_method_combined_text", "contains_word", "accounts", ["c_nationkey", "segment"],
          [("Birleşik Kolon", "contains(CAST(c_nationkey AS VARCHAR) || coalesce('-' || nullif(lower(segment), ''), ''), '1-b')",
            "CAST(c_nationkey AS VARCHAR) || coalesce('-' || nullif(lower(segment), ''), '')")],
          _WORDS, method="combined_text", keywords="1-b", separator="-")
row_check("check_method_first_non_empty", "contains_word", "accounts", ["segment", "c_nationkey"],
          [("Birleşik Kolon", "contains(coalesce(nullif(lower(segment), ''), CAST(c_nationkey AS VARCHAR)), '1')",
            "coalesce(nullif(lower(segment), ''), CAST(c_nationkey AS VARCHAR))")],
          _WORDS, method="first_non_empty", keywords="1")
row_check("check_method_row_sum", "high_amount", "accounts", ["c_nationkey", "c_custkey"],
          [("Satır Toplamı", "c_nationkey + c_custkey >= 1000", "CAST(c_nationkey + c_custkey AS DOUBLE)")],
          "Yuksek tutar", method="row_sum", min_amount=1000)
row_check("check_method_row_diff", "negative", "accounts", ["c_nationkey", "c_custkey"],
          [("Satır Farkı", "c_nationkey < c_custkey", "CAST(c_nationkey - c_custkey AS DOUBLE)")],
          "Negatif tutar", method="row_diff")

# -- repeated keys -----------------------------------------------------------------------


def _numbered(relation: str, key: str, order: str) -> str:
    """Rows with group size and the number of their group by first appearance."""
    return f"""(WITH k AS (SELECT *, {key} AS the_key FROM {relation}),
      g AS (SELECT the_key, count(*) AS n, row_number() OVER (ORDER BY min({order})) AS g FROM k GROUP BY 1)
      SELECT k.*, g.n, g.g FROM k JOIN g USING (the_key))"""


_TWO = "lower(CAST(o_custkey AS VARCHAR)) || '#' || lower(o_orderpriority)"
plain_check(
    "check_method_combination", "duplicates", "postings", ["o_custkey", "o_orderpriority"], ["group_count", "check_result"],
    f"""SELECT o_orderkey, n AS group_count, 'Duplicate' AS check_result
        FROM {_numbered(POSTINGS_SQL, _TWO, "o_orderkey")} WHERE n >= 2""",
    method="combination",
)
for _mode, _rank in (("all", ""), ("second", "AND rn > 1"), ("first", "AND rn < n")):
    plain_check(
        f"check_duplicates_{_mode}", "duplicates", "postings", ["o_custkey", "o_orderpriority"],
        ["check_name", "group_count", "group_id", "check_result"],
        f"""SELECT o_orderkey, 'Check duplicates' AS check_name, n AS group_count, g AS group_id, 'Duplicate' AS check_result
            FROM (SELECT *, row_number() OVER (PARTITION BY the_key ORDER BY o_orderkey) AS rn
                  FROM {_numbered(POSTINGS_SQL, _TWO, "o_orderkey")}) WHERE n >= 3 {_rank}""",
        order_by=["o_orderkey"], keep_mode=_mode, min_count=3,
    )
plain_check(
    "check_duplicate_documents", "duplicates", "documents", ["text"], ["group_count", "group_id", "check_result"],
    f"""SELECT doc_id, n AS group_count, g AS group_id, 'Duplicate' AS check_result
        FROM {_numbered("documents", "lower(trim(text))", "doc_id")} WHERE n > 1""",
    order_by=["doc_id"],
)
plain_check(
    "check_unique", "unique", "documents", ["text"], ["check_name", "group_count", "group_id", "check_result"],
    f"""SELECT doc_id, 'Check unique' AS check_name, n AS group_count, g AS group_id, 'Benzersiz' AS check_result
        FROM {_numbered("documents", "lower(trim(text))", "doc_id")} WHERE n = 1""",
    order_by=["doc_id"],
)
plain_check(
    "check_duplicate_amount", "duplicate_amount", "accounts", ["balance"], ["check_name", "group_count", "group_id"],
    f"""SELECT c_custkey, 'Check duplicate_amount' AS check_name, n AS group_count, g AS group_id
        FROM {_numbered(ACCOUNTS_SQL, "coalesce(CAST(round_even(balance, 2) AS VARCHAR), '')", "c_custkey")} WHERE n >= 2""",
    order_by=["c_custkey"],
)
plain_check(
    "check_same_day_same_amount", "same_day_same_amount", "events", [], ["check_name", "group_count", "group_id"],
    f"""SELECT event_id, 'Check same_day_same_amount' AS check_name, n AS group_count, g AS group_id
        FROM {_numbered("events", "CAST(CAST(ts AS DATE) AS VARCHAR) || '#' || CAST(round_even(value, 1) AS VARCHAR)", "event_id")}
        WHERE n >= 3""",
    order_by=["event_id"], date_col="ts", amount_col="value", decimal_precision=1, min_count=3,
)
plain_check(
    "check_duplicate_invoice_payment", "duplicate_invoice_payment", "accounts", ["segment", "balance"],
    ["check_name", "group_count", "group_id", "risk_level"],
    f"""SELECT c_custkey, 'Check duplicate_invoice_payment' AS check_name, n AS group_count, g AS group_id,
        'Yüksek' AS risk_level FROM {_numbered(
            ACCOUNTS_SQL, "lower(coalesce(segment, '')) || '#' || coalesce(CAST(round_even(balance, 2) AS VARCHAR), '')",
            "c_custkey")} WHERE n >= 2""",
    order_by=["c_custkey"], amount_col="balance",
)


@query(
    "check_reversal",
    f"""WITH b AS (SELECT c_custkey, segment, CASE WHEN c_custkey % 2 = 0 THEN floor(balance / 10) ELSE -floor(balance / 10) END AS tutar
        FROM {ACCOUNTS_SQL}),
        k AS (SELECT *, lower(coalesce(segment, '')) || '#' || coalesce(CAST(abs(tutar) AS VARCHAR), '') AS the_key FROM b)
        SELECT c_custkey, tutar, count(*) OVER (PARTITION BY the_key) AS group_count, 'Yüksek' AS risk_level FROM k
        QUALIFY count(*) OVER (PARTITION BY the_key) >= 2""",
)
def _reversal(spark, sf):
    tens = F.floor(F.col("balance") / 10).cast("double")
    df = accounts(spark, sf).withColumn("TUTAR", F.when(F.col("c_custkey") % 2 == 0, tens).otherwise(-tens))
    found = run_check(df, "reversal_check", ["segment", "TUTAR"])
    return found.select("c_custkey", F.col("TUTAR").alias("tutar"), "group_count", "risk_level")


plain_check(
    "check_document_sequence_gap", "document_sequence_gap", "postings", ["doc"],
    ["check_name", "group_count", "check_result", "risk_level"],
    f"""WITH p AS (SELECT *, lower(coalesce(doc, '')) AS k FROM {POSTINGS_SQL}),
        c AS (SELECT k, count(*) AS n FROM p GROUP BY 1)
        SELECT o_orderkey, 'Check document_sequence_gap' AS check_name, n AS group_count,
        'Bos veya mukerrer belge numarasi' AS check_result, 'Orta' AS risk_level
        FROM p JOIN c USING (k) WHERE k = '' OR n > 1""",
)
plain_check(
    "check_rare_user_transactions", "rare_user_transactions", "postings", ["o_custkey"],
    ["check_name", "group_count", "risk_level"],
    f"""WITH p AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM {POSTINGS_SQL})
        SELECT o_orderkey, 'Check rare_user_transactions' AS check_name, n AS group_count, 'Orta' AS risk_level
        FROM p WHERE n <= 6""",
    max_count=6,
)
plain_check(
    "check_user_intensity", "user_intensity", "events", ["user_id"],
    ["check_name", "check_result", "group_count", "risk_level"],
    """WITH u AS (SELECT user_id, count(*) AS n, sum(abs(value)) AS total FROM events GROUP BY 1)
       SELECT event_id, 'Check user_intensity' AS check_name, 'Kullanici yogunluk analizi' AS check_result,
       n AS group_count, 'Orta' AS risk_level FROM events JOIN u USING (user_id) WHERE n >= 80 OR total >= 5000""",
    min_count=80, amount_col="value", amount_threshold=5000,
)

# -- vouchers ----------------------------------------------------------------------------

_SPLIT_KEY = "CAST(l_suppkey AS VARCHAR) || '#' || coalesce(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), '')"
plain_check(
    "check_split_transaction", "split_transaction", "ledger", ["price"],
    ["check_name", "group_total", "risk_level"],
    f"""WITH k AS (SELECT *, {_SPLIT_KEY} AS the_key FROM {LEDGER_SQL}),
        g AS (SELECT the_key, sum(abs(price)) AS total, count(*) AS n FROM k GROUP BY 1)
        SELECT {_LEDGER_KEYS}, 'Check split_transaction' AS check_name, round(total, 2) AS group_total, 'Yüksek' AS risk_level
        FROM k JOIN g USING (the_key) WHERE abs(price) < 100000 AND total >= 100000 AND n >= 2""",
    supplier_col="l_suppkey", date_col="l_shipdate", rounding={"group_total": 2},
)
plain_check(
    "check_single_leg_voucher", "single_leg_voucher", "ledger", [], ["check_name", "check_result", "risk_level"],
    f"""WITH l AS (SELECT * FROM {LEDGER_SQL}),
        v AS (SELECT voucher, count(*) AS n, sum(coalesce(debit, 0)) AS d, sum(coalesce(credit, 0)) AS c FROM l GROUP BY 1)
        SELECT {_LEDGER_KEYS}, 'Check single_leg_voucher' AS check_name, 'Tek bacakli fis' AS check_result, 'Yüksek' AS risk_level
        FROM l JOIN v ON l.voucher IS NOT DISTINCT FROM v.voucher
        WHERE n <= 1 OR (d > 0 AND c = 0) OR (c > 0 AND d = 0)""",
    voucher_col="voucher", debit_col="debit", credit_col="credit",
)
def _sizes(spark, sf):
    """Vouchers of three kinds: with 1e32 on both sides beside small amounts, in billionths, and as they are."""
    kind, first = F.col("l_orderkey") % 3, F.col("l_linenumber") == 1
    price, debit = F.col("l_extendedprice"), F.col("l_returnflag") == "A"

    def side(mine):
        return F.when((kind == 0) & first, F.lit(1e32)).when(mine, F.when(kind == 1, price * 1e-9).otherwise(price))

    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", side(debit).alias("debit"), side(~debit).alias("credit"))


_SIZES_SQL = """(SELECT l_orderkey, l_linenumber, l_orderkey % 3 AS kind,
    CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 1 THEN 0 WHEN l_returnflag = 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END AS debit,
    CASE WHEN l_orderkey % 3 = 0 AND l_linenumber = 1 THEN 0 WHEN l_returnflag <> 'A' THEN CAST(l_extendedprice AS DECIMAL(18,2)) ELSE 0 END AS credit
    FROM lineitem)"""


@query(
    "check_debit_credit_imbalance_all_sizes",
    f"""WITH v AS (SELECT l_orderkey, kind, CAST(sum(debit) - sum(credit) AS DOUBLE) AS gap FROM {_SIZES_SQL} GROUP BY ALL)
        SELECT l_orderkey, l_linenumber, round(gap, 2) AS difference,
        CASE WHEN kind <> 1 AND abs(gap) > 1000 THEN 'Yüksek' ELSE 'Orta' END AS risk_level
        FROM lineitem JOIN v USING (l_orderkey) WHERE gap <> 0""",
)
def _imbalance_sizes(spark, sf):
    found = run_check(_sizes(spark, sf), "debit_credit_imbalance", "l_orderkey", debit_col="debit", credit_col="credit")
    gap = F.when(F.col("l_orderkey") % 3 == 1, F.col("difference") * 1e9).otherwise(F.col("difference"))
    return found.select("l_orderkey", "l_linenumber", F.round(gap, 2).alias("difference"), "risk_level")


@query(
    "check_single_leg_voucher_all_sizes",
    f"""WITH v AS (SELECT l_orderkey, kind, count(*) AS n, sum(debit) AS d, sum(credit) AS c,
          bool_or(l_linenumber = 1 AND kind = 0) AS paired FROM {_SIZES_SQL} GROUP BY ALL)
        SELECT l_orderkey, l_linenumber FROM lineitem JOIN v USING (l_orderkey)
        WHERE n <= 1 OR (NOT paired AND ((d > 0 AND c = 0) OR (c > 0 AND d = 0)))""",
)
def _single_leg_sizes(spark, sf):
    found = run_check(_sizes(spark, sf), "single_leg_voucher", "l_orderkey", voucher_col="l_orderkey", debit_col="debit", credit_col="credit")
    return found.select("l_orderkey", "l_linenumber")


plain_check(
    "check_debit_credit_imbalance", "debit_credit_imbalance", "ledger", ["voucher"],
    ["check_name", "debit_total", "credit_total", "difference", "risk_level"],
    f"""WITH l AS (SELECT * FROM {LEDGER_SQL}),
        v AS (SELECT voucher, sum(coalesce(debit, 0)) AS d, sum(coalesce(credit, 0)) AS c FROM l GROUP BY 1)
        SELECT {_LEDGER_KEYS}, 'Check debit_credit_imbalance' AS check_name, round(d, 2) AS debit_total,
        round(c, 2) AS credit_total, round(d - c, 2) AS difference,
        CASE WHEN abs(d - c) > 1000 THEN 'Yüksek' ELSE 'Orta' END AS risk_level
        FROM l JOIN v ON l.voucher IS NOT DISTINCT FROM v.voucher WHERE abs(d - c) > 500""",
    debit_col="debit", credit_col="credit", tolerance=500,
    rounding={"debit_total": 2, "credit_total": 2, "difference": 2},
)


@query(
    "check_debit_credit_split",
    f"""SELECT c_custkey, CASE WHEN balance > 0 THEN balance ELSE 0 END AS "CALC_DEBIT",
        CASE WHEN balance < 0 THEN -balance ELSE 0 END AS "CALC_CREDIT", 'split' AS check_name,
        'Borç/Alacak kolonları hesaplandı' AS check_result,
        'Tek kolon: balance; pozitif=borç, negatif=alacak' AS match_reason FROM {ACCOUNTS_SQL}""",
)
def _split_single(spark, sf):
    out = run_check(accounts(spark, sf), "debit_credit_split", name="split", amount_col="balance")
    return out.select("c_custkey", "CALC_DEBIT", "CALC_CREDIT", "check_name", "check_result", "match_reason")


@query(
    "check_debit_credit_split_reversed",
    f"""SELECT c_custkey, CASE WHEN balance < 0 THEN -balance ELSE 0 END AS "CALC_DEBIT",
        CASE WHEN balance > 0 THEN balance ELSE 0 END AS "CALC_CREDIT" FROM {ACCOUNTS_SQL}""",
)
def _split_reversed(spark, sf):
    out = run_check(accounts(spark, sf), "debit_credit_split", amount_col="balance", helpers=False,
                    single_amount_direction="negative_debit")
    return out.select("c_custkey", "CALC_DEBIT", "CALC_CREDIT")


@query(
    "check_debit_credit_split_separate",
    f"""SELECT {_LEDGER_KEYS}, coalesce(debit, 0) AS "CALC_DEBIT", coalesce(credit, 0) AS "CALC_CREDIT",
        'Ayrı kolonlar: debit / credit' AS match_reason FROM {LEDGER_SQL}""",
)
def _split_separate(spark, sf):
    out = run_check(ledger(spark, sf), "debit_credit_split", amount_structure="separate", debit_col="debit",
                    credit_col="credit")
    return out.select(*LEDGER_ROW, "CALC_DEBIT", "CALC_CREDIT", "match_reason")


# -- risk --------------------------------------------------------------------------------

plain_check(
    "check_benford", "benford", "postings", ["o_totalprice"], ["check_name", "digit_share", "risk_level"],
    f"""WITH d AS (SELECT o_orderkey, CAST(substr(CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), 1, 1) AS INTEGER) AS digit
          FROM {POSTINGS_SQL} WHERE o_totalprice > 5000),
        s AS (SELECT digit, count(*) / (SELECT count(*) FROM d) AS share FROM d GROUP BY 1)
        SELECT o_orderkey, 'Check benford' AS check_name, round(share, 9) AS digit_share, 'Orta' AS risk_level
        FROM d JOIN s USING (digit) WHERE abs(share - log10(1 + 1.0 / digit)) > 0.08""",
    min_amount=5000, rounding={"digit_share": 9},
)
plain_check(
    "check_journal_risk", "journal_risk", "postings", [], ["check_name", "risk_score", "risk_level", "review_note"],
    f"""WITH s AS (SELECT o_orderkey, CAST((CASE WHEN abs(o_totalprice) > 100000 THEN 30 ELSE 0 END)
          + (CASE WHEN length(note) < 5 THEN 15 ELSE 0 END) + (CASE WHEN o_orderkey % 3 IN (0, 2) THEN 25 ELSE 0 END)
          + (CASE WHEN isodow(o_orderdate) > 5 THEN 20 ELSE 0 END) AS INTEGER) AS score FROM {POSTINGS_SQL})
        SELECT o_orderkey, 'Check journal_risk' AS check_name, score AS risk_score,
        CASE WHEN score <= 20 THEN 'Düşük' WHEN score <= 50 THEN 'Orta' WHEN score <= 80 THEN 'Yüksek' ELSE 'Kritik' END AS risk_level,
        'Otomatik risk skoru' AS review_note FROM s WHERE score >= 20""",
    amount_col="o_totalprice", description_col="note", user_col="person", datetime_col="o_orderdate",
)

# -- chains, scopes, counts --------------------------------------------------------------


@query(
    "check_chain_and",
    f"""WITH a AS (SELECT * FROM {POSTINGS_SQL} WHERE o_totalprice >= 300000),
        b AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM a)
        SELECT o_orderkey, n AS group_count, 'repeat' AS check_name, 'Yuksek tutar' AS match_reason FROM b WHERE n > 1""",
)
def _chain_and(spark, sf):
    checks = [
        {"check": "high_amount", "columns": "o_totalprice", "min_amount": 300000},
        {"check": "duplicates", "columns": ["o_custkey"], "name": "repeat"},
    ]
    return chain_and(postings(spark, sf), checks).select("o_orderkey", "group_count", "check_name", "match_reason")


@query(
    "check_chain_or",
    f"""WITH p AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM {POSTINGS_SQL})
        SELECT o_orderkey,
          CASE WHEN o_totalprice >= 450000 THEN 'big' WHEN isodow(o_orderdate) > 5 THEN 'weekend' ELSE 'repeat' END AS check_name,
          CASE WHEN o_totalprice >= 450000 THEN CAST(o_totalprice AS VARCHAR)
               WHEN isodow(o_orderdate) > 5 THEN CAST(o_orderdate AS VARCHAR) END AS matched_value,
          CASE WHEN NOT (o_totalprice >= 450000 OR isodow(o_orderdate) > 5) THEN n END AS group_count
        FROM p WHERE o_totalprice >= 450000 OR isodow(o_orderdate) > 5 OR n >= 5""",
)
def _chain_or(spark, sf):
    checks = [
        {"check": "high_amount", "columns": "o_totalprice", "name": "big", "min_amount": 450000},
        {"check": "weekend", "columns": "o_orderdate"},
        {"check": "duplicates", "columns": ["o_custkey", "o_orderpriority"], "name": "repeat", "min_count": 5},
    ]
    return chain_or(postings(spark, sf), checks).select("o_orderkey", "check_name", "matched_value", "group_count")


@query(
    "check_unmatched_scope",
    f"""WITH p AS (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM {POSTINGS_SQL})
        SELECT o_orderkey, o_totalprice FROM p WHERE n < 3""",
)
def _unmatched(spark, sf):
    rest = run_check(postings(spark, sf), "duplicates", ["o_custkey", "o_orderpriority"], scope="unmatched", min_count=3)
    return rest.select("o_orderkey", "o_totalprice")


@query(
    "check_result_counts",
    f"""SELECT count(*) AS total_rows, count(*) FILTER (balance < 0) AS result_rows,
        count(*) FILTER (balance IS NULL OR balance >= 0) AS excluded_rows FROM {ACCOUNTS_SQL}""",
)
def _counts(spark, sf):
    return result_counts(accounts(spark, sf), "negative", "balance")


@query(
    "check_result_sample",
    f"""SELECT c_custkey, coalesce(segment, '') AS segment, coalesce(balance, 0) AS balance FROM {ACCOUNTS_SQL}
        WHERE balance < 0 ORDER BY c_custkey LIMIT 50""",
)
def _result_sample(spark, sf):
    """The preview of a result: its first fifty rows, missing values filled."""
    found = result_sample(accounts(spark, sf), "negative", "balance", limit=50, order_by=["c_custkey"])
    return found.select("c_custkey", "segment", "balance")
