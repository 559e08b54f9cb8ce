"""The three flagship scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import LEDGER_ROW, LEDGER_SQL, ledger, query, table
from ledgerscan.operators import scans

_KEYS = ", ".join(LEDGER_ROW)
_CRITERIA = [
    {"name": "SALES", "main": ["600"], "counter": ["100", " 120 "]},
    {"name": "OTHER", "main": ["999"], "counter": ["600"]},
    {"name": "SKIPPED", "main": ["100"], "counter": [" "]},
]
_UNUSUAL_SQL = f"""WITH l AS (SELECT *, substr(account, 1, 3) AS code FROM {LEDGER_SQL}),
  v AS (SELECT voucher, count(*) AS n, count(*) FILTER (code = '600') AS m0, count(*) FILTER (code IN ('100', '120')) AS c0,
        count(*) FILTER (code = '999') AS m1, count(*) FILTER (code = '600') AS c1 FROM l WHERE voucher IS NOT NULL GROUP BY 1)"""


@query(
    "scan_user_activity",
    """SELECT user_id AS "KULLANICI_KIMLIGI", count(*) AS "NO_OF_RECORDS",
       round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS "BORC_TUTARI_SUM",
       round(sum(CASE WHEN event_type <> 'purchase' THEN value ELSE 0 END), 4) AS "ALACAK_TUTARI_SUM",
       round(sum(value), 4) AS "value_SUM" FROM events GROUP BY 1""",
)
def _users(spark, sf):
    bought = F.col("event_type") == "purchase"
    shown = F.translate(F.col("value").cast("string"), ".", ",")
    df = table(spark, sf, "events").select(
        "user_id", F.when(bought, shown).alias("debit"), F.when(~bought, shown).otherwise("-").alias("credit"), "value"
    )
    out = scans.user_activity(df, "user_id", "debit", "credit", ["value", "debit"])
    sums = [n for n in out.columns if n.endswith("_SUM")]
    return out.withColumns({n: F.round(n, 4) for n in sums})


def _whole(word: str) -> str:
    return f"regexp_matches(f, '(^|[^a-z0-9]){word}([^a-z0-9]|$)')"


_FOLDED = "(SELECT doc_id, lower(translate(text, 'ıİğĞşŞüÜöÖçÇ', 'iiggssuuoocc')) AS f FROM documents)"


@query(
    "scan_keywords_whole_word",
    f"""SELECT doc_id, concat_ws(', ', CASE WHEN {_whole("die")} THEN 'DIE' END, CASE WHEN {_whole("token")} THEN 'token' END,
          CASE WHEN {_whole("ueb")} THEN 'üeb' END, CASE WHEN {_whole("and")} THEN 'and' END) AS "Eşleşen Anahtar Kelimeler"
        FROM {_FOLDED} WHERE {_whole("die")} OR {_whole("token")} OR {_whole("ueb")} OR {_whole("and")}""",
)
def _words(spark, sf):
    found = scans.keyword_scan(table(spark, sf, "documents"), ["text"], ["DIE", "token", "üeb", "and"], "tam")
    return found.select(scans.KEYWORDS, "doc_id")


@query(
    "scan_keywords_content",
    f"""SELECT doc_id, concat_ws(', ', CASE WHEN contains(f, 'heitu') THEN 'HEİTÜ' END, CASE WHEN contains(f, 'token') THEN 'token' END,
        CASE WHEN contains(f, 'ion') THEN 'ion' END) AS "Eşleşen Anahtar Kelimeler"
        FROM {_FOLDED} WHERE contains(f, 'heitu') OR contains(f, 'token') OR contains(f, 'ion')""",
)
def _content(spark, sf):
    found = scans.keyword_scan(table(spark, sf, "documents"), ["text"], ["HEİTÜ", "token", "ion"], "icerik")
    return found.select(scans.KEYWORDS, "doc_id")


@query(
    "scan_keywords_two_columns",
    """SELECT p_partkey, p_name, p_type, concat_ws(', ', CASE WHEN contains(lower(p_name), 'red') THEN 'red' END,
       CASE WHEN contains(lower(p_type), 'promo') OR contains(lower(p_name), 'promo') THEN 'Promo' END) AS "Eşleşen Anahtar Kelimeler"
       FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'promo')""",
)
def _two_columns(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    return scans.keyword_scan(df, ["p_name", "p_type"], ["red", "Promo"], "icerik")


@query(
    "scan_keyword_counts",
    f"""SELECT keyword, matched FROM (SELECT count(*) FILTER ({_whole("die")}) AS a, count(*) FILTER ({_whole("token")}) AS b,
        count(*) FILTER ({_whole("zzz")}) AS c FROM {_FOLDED}) s,
        LATERAL (VALUES ('die', a), ('token', b), ('zzz', c)) AS t(keyword, matched)""",
)
def _counts(spark, sf):
    return scans.keyword_counts(table(spark, sf, "documents"), ["text"], ["die", "token", "zzz"], "tam")


@query(
    "scan_keyword_summary",
    f"""SELECT count(*) AS total_rows, count(*) FILTER (contains(f, 'heitu') OR contains(f, 'token')) AS matched_rows FROM {_FOLDED}""",
)
def _summary(spark, sf):
    return scans.keyword_summary(table(spark, sf, "documents"), ["text"], ["heitü", "token"], "icerik")


@query(
    "scan_unusual_accounts",
    f"""{_UNUSUAL_SQL}
        SELECT {_KEYS}, voucher, account, n AS "NO_OF_RECORDS", m0 AS "FLAG_SALES_ANA", c0 AS "FLAG_SALES_KARSI",
          1 AS "UNUSUAL_SALES", CAST(0 AS BIGINT) AS "FLAG_OTHER_ANA", CAST(0 AS BIGINT) AS "FLAG_OTHER_KARSI", 0 AS "UNUSUAL_OTHER"
        FROM l JOIN v USING (voucher) WHERE m0 > 0 AND c0 = 0
        UNION ALL
        SELECT {_KEYS}, voucher, account, n, 0, 0, 0, m1, c1, 1 FROM l JOIN v USING (voucher) WHERE m1 > 0 AND c1 = 0""",
)
def _unusual(spark, sf):
    df = ledger(spark, sf).select(*LEDGER_ROW, "voucher", "account")
    return scans.unusual_accounts(df, "account", "voucher", _CRITERIA)


@query(
    "scan_unusual_summary",
    f"""{_UNUSUAL_SQL}, s AS (SELECT count(*) AS total_vouchers, count(*) FILTER (m0 > 0 AND c0 = 0) AS u0,
          count(*) FILTER (m1 > 0 AND c1 = 0) AS u1 FROM v)
        SELECT 'SALES' AS criterion, u0 AS unusual_vouchers, '600' AS main_codes, '100, 120' AS counter_codes, total_vouchers FROM s
        UNION ALL SELECT 'OTHER', u1, '999', '600', total_vouchers FROM s""",
)
def _unusual_summary(spark, sf):
    return scans.unusual_summary(ledger(spark, sf), "account", "voucher", _CRITERIA)
