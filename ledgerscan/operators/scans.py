"""The three flagship scans: user activity, keywords, unusual account pairings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscan.functions import coerce as c
from ledgerscan.plans import keyed

# Column names of the scan reports.
USER, RECORDS, DEBIT_SUM, CREDIT_SUM = "KULLANICI_KIMLIGI", "NO_OF_RECORDS", "BORC_TUTARI_SUM", "ALACAK_TUTARI_SUM"
KEYWORDS = "Eşleşen Anahtar Kelimeler"


def user_activity(
    df: DataFrame, user: str, debit: str | None = None, credit: str | None = None, amounts: Sequence[str] = ()
) -> DataFrame:
    """Rows and plain amount sums per user, busiest first; rows without a user are left out."""
    sums = {}
    if debit:
        sums[DEBIT_SUM] = debit
    if credit:
        sums[CREDIT_SUM] = credit
    sums.update({f"{a}_SUM": a for a in amounts if a not in (debit, credit)})

    def plain(name: str):
        x = F.col(f"`{name}`").cast("double") if c.is_numeric(df.schema[name].dataType) else c.simple_number(name)
        return F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))

    return (
        df.filter(F.col(f"`{user}`").isNotNull())
        .groupBy(F.col(f"`{user}`").alias(USER))
        .agg(F.count(F.lit(1)).alias(RECORDS), *[F.sum(plain(n)).alias(out) for out, n in sums.items()])
        .orderBy(F.desc(RECORDS), F.asc(USER))
    )


def _keyword_test(word: str, whole_word: bool):
    folded = c.fold_word(word)
    if not whole_word:
        return lambda t: t.contains(folded)
    pattern = "(?<![a-z0-9])" + c.any_of([folded]) + "(?![a-z0-9])"
    return lambda t: t.contains(folded) & t.rlike(pattern)


def _keyword_tests(texts: Column, count: int, words: Sequence[str], whole_word: bool) -> list[Column]:
    """One boolean per keyword over an array of folded texts."""
    tests = []
    for word in words:
        test = _keyword_test(word, whole_word)
        found = F.lit(False)
        for i in range(count):
            found = found | test(F.get(texts, F.lit(i)))
        tests.append(found)
    return tests


def _folded_texts(df: DataFrame, columns: Sequence[str]) -> tuple[Column, int]:
    known = [n for n in columns if n in df.columns]
    return F.array(*[c.folded(n) for n in known]), len(known)


def keyword_scan(df: DataFrame, columns: Sequence[str], words: Sequence[str], mode: str = "tam") -> DataFrame:
    """Rows that hold any keyword, with the list of the matched ones as first column.

    ``mode`` is ``tam`` (whole word) or ``icerik`` (anywhere in the text). Texts are folded once per
    row; exploding the list of at most one result drops the other rows without a second evaluation.
    """
    words = list(dict.fromkeys(words))
    texts, count = _folded_texts(df, columns)

    def listed(folded: Column) -> Column:
        tests = _keyword_tests(folded, count, words, mode != "icerik")
        return F.concat_ws(", ", *[F.when(t, F.lit(w)) for t, w in zip(tests, words, strict=True)])

    found = F.filter(F.array(c.let(texts, listed)), lambda v: v != "")
    return df.select(F.explode(found).alias(KEYWORDS), *[F.col(f"`{n}`") for n in df.columns])


def _keyword_flags(df: DataFrame, columns: Sequence[str], words: Sequence[str], mode: str) -> DataFrame:
    texts, count = _folded_texts(df, columns)

    def flags(folded: Column) -> Column:
        return F.array(*_keyword_tests(folded, count, words, mode != "icerik"))

    return df.select(c.let(texts, flags).alias("flags"))


def keyword_counts(df: DataFrame, columns: Sequence[str], words: Sequence[str], mode: str = "tam") -> DataFrame:
    """Matched rows per keyword (also those never found)."""
    words = list(dict.fromkeys(words))
    hits = _keyword_flags(df, columns, words, mode)
    counts = hits.agg(*[F.count_if(F.get("flags", F.lit(k))).alias(f"__k{k}") for k in range(len(words))])
    pairs = [F.struct(F.lit(w).alias("keyword"), F.col(f"__k{k}").alias("matched")) for k, w in enumerate(words)]
    return counts.select(F.inline(F.array(*pairs)))


def keyword_summary(df: DataFrame, columns: Sequence[str], words: Sequence[str], mode: str = "tam") -> DataFrame:
    """One row: scanned rows and matched rows."""
    hits = _keyword_flags(df, columns, list(dict.fromkeys(words)), mode)
    return hits.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(F.array_contains("flags", True)).alias("matched_rows")
    )


def _criteria(criteria: Sequence[dict]) -> list[tuple[str, list[str], list[str]]]:
    """Name, main codes and counter codes; criteria with an empty side are skipped."""
    out = []
    for item in criteria:
        main = [v.strip() for v in item.get("main", []) if v.strip()]
        counter = [v.strip() for v in item.get("counter", []) if v.strip()]
        if main and counter:
            out.append((item["name"], main, counter))
    return out


def _voucher_counts(df: DataFrame, account: str, voucher: str, criteria: Sequence[dict], match_len: int) -> DataFrame:
    """One row per voucher: its rows, and main/counter rows and verdict of every criterion."""
    code = F.substring(c.strip(c.text(account)), 1, match_len)
    aggs = {}
    for i, (_, main, counter) in enumerate(_criteria(criteria)):
        aggs[f"__main{i}"] = F.count_if(code.isin(main))
        aggs[f"__counter{i}"] = F.count_if(code.isin(counter))
    known = df.filter(F.col(f"`{voucher}`").isNotNull())
    return keyed.group_stats(known, {"__key": F.col(f"`{voucher}`")}, aggs)


def unusual_accounts(
    df: DataFrame, account: str, voucher: str, criteria: Sequence[dict], match_len: int = 3
) -> DataFrame:
    """All rows of vouchers that use a main account and none of its counter accounts.

    One aggregation serves all criteria; rows of a voucher that fails several appear once per
    criterion, with the columns of the other criteria at 0.
    """
    named = _criteria(criteria)
    others = [n for n in df.columns if n != voucher]
    if not named:
        return df.filter(F.lit(False)).select(voucher, F.lit(0).cast("long").alias(RECORDS), *others)
    counts = _voucher_counts(df, account, voucher, criteria, match_len)
    verdicts = [(F.col(f"__main{i}") > 0) & (F.col(f"__counter{i}") == 0) for i in range(len(named))]
    any_verdict = verdicts[0]
    for v in verdicts[1:]:
        any_verdict = any_verdict | v
    rows = keyed.attach(df, {"__key": F.col(f"`{voucher}`")}, counts, keep=any_verdict)
    zero = F.lit(0).cast("long")
    per_criterion = []
    for i, verdict in enumerate(verdicts):
        fields = [F.lit(i).alias("at"), verdict.alias("hit")]
        per_criterion.append(F.struct(*fields))
    failed = F.filter(F.array(*per_criterion), lambda s: s["hit"])
    rows = rows.withColumn("__failed", F.explode(F.transform(failed, lambda s: s["at"])))
    flags = []
    for i, (name, _, _) in enumerate(named):
        mine = F.col("__failed") == i
        flags.append(F.when(mine, F.col(f"__main{i}")).otherwise(zero).alias(f"FLAG_{name}_ANA"))
        flags.append(F.when(mine, F.col(f"__counter{i}")).otherwise(zero).alias(f"FLAG_{name}_KARSI"))
        flags.append(F.when(mine, F.lit(1)).otherwise(F.lit(0)).alias(f"UNUSUAL_{name}"))
    return rows.select(
        F.col(f"`{voucher}`"), F.col("__weight").alias(RECORDS), *flags, *[F.col(f"`{n}`") for n in others]
    )


def unusual_summary(
    df: DataFrame, account: str, voucher: str, criteria: Sequence[dict], match_len: int = 3
) -> DataFrame:
    """Unusual vouchers per criterion, with the number of all vouchers."""
    named = _criteria(criteria)
    counts = _voucher_counts(df, account, voucher, criteria, match_len)
    sums = [
        F.count_if((F.col(f"__main{i}") > 0) & (F.col(f"__counter{i}") == 0)).alias(f"__u{i}") for i in range(len(named))
    ]
    one = counts.agg(F.count(F.lit(1)).alias("total_vouchers"), *sums)
    pairs = F.array(
        *[
            F.struct(
                F.lit(name).alias("criterion"),
                F.col(f"__u{i}").alias("unusual_vouchers"),
                F.lit(", ".join(main)).alias("main_codes"),
                F.lit(", ".join(counter)).alias("counter_codes"),
            )
            for i, (name, main, counter) in enumerate(named)
        ]
    )
    return one.select(F.inline(pairs), "total_vouchers")
