"""Checks that decide from one row: blanks, words, amounts, dates, accounts, users."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscan.functions import coerce as c
from ledgerscan.functions import maths
from ledgerscan.operators import predicates as p
from ledgerscan.operators.checks import labels
from ledgerscan.operators.checks.base import (
    Check,
    Tested,
    combine,
    number_subjects,
    row_result,
    simple_result,
    text_subjects,
)

_ALL_TEXT = ".*"


def _raw(name: str) -> Column:
    return F.col(f"`{name}`")


def _by_text(req: Check, operator: str, reason: str, value="", values=None, match=None) -> DataFrame:
    cond = p.Condition(
        "", operator, value, values=values, case_sensitive=bool(req.params.get("case_sensitive", False))
    )
    tested = [Tested(label, p.test_of(req.df, s, cond), s) for label, s in text_subjects(req)]
    return row_result(req, tested, reason, match)


def _by_words(req: Check, words: list[str], reason: str, operator: str = "regex", prefix: str = "") -> DataFrame:
    pattern = c.any_of(words) if words else _ALL_TEXT
    return _by_text(req, operator, reason, f"{prefix}(?:{pattern})")


def _by_number(req: Check, operator: str, reason: str, value="", value2="") -> DataFrame:
    cond = p.Condition("", operator, value, value2, dtype="numeric")
    tested = []
    for label, x in number_subjects(req):
        own = label in req.columns
        test = p.test_of(req.source, label if own else x, cond, order_by=req.order_by)
        tested.append(Tested(label, test, _raw(label) if own else x))
    return row_result(req, tested, reason)


def _by_column(req: Check, build, reason: str) -> DataFrame:
    return row_result(req, [Tested(n, build(n), _raw(n)) for n in req.columns], reason)


# -- blanks ------------------------------------------------------------------------------


def blank(req: Check, name: str) -> Column:
    """Null, empty, a placeholder, or (optionally) zero or an unreadable date."""
    opt = req.params.get
    ignore_case = opt("ignore_case", True)
    t = c.normalized(name, opt("trim", True), case_sensitive=not ignore_case)
    invalid = {v.lower() for v in c.value_list(opt("invalid_values", ""), ignore_case=ignore_case)}
    if opt("placeholder_as_blank", True):
        invalid |= set(labels.BLANK_PLACEHOLDERS)
    tests = []
    if opt("null_as_blank", True):
        tests.append(_raw(name).isNull())
    if opt("empty_string_as_blank", True):
        tests.append(t == "")
    if invalid:
        tests.append(t.isin(sorted(invalid)))
    if opt("zero_as_blank", False):
        tests.append(req.num(name) == 0)
    if opt("invalid_dates_as_blank", False):
        tests.append(req.moment(name).isNull())
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]) if tests else F.lit(False)


def empty(req: Check) -> DataFrame:
    return _by_column(req, lambda n: blank(req, n), labels.REASONS["empty"])


def not_empty(req: Check) -> DataFrame:
    tested = [Tested(n, ~blank(req, n), _raw(n)) for n in req.columns]
    least = req.whole("min_len", 1)
    if least <= 1:
        return row_result(req, tested, labels.REASONS["empty"])
    long_enough = combine(
        [F.length(c.normalized(n, req.params.get("trim", True))) >= least for n in req.columns], req.method
    )
    return row_result(req, tested, labels.REASONS["empty"], lambda masks: combine(masks, req.method) & long_enough)


# -- words -------------------------------------------------------------------------------


def contains_word(req: Check) -> DataFrame:
    return _by_words(req, c.value_list(req.param("keywords", "")), labels.REASONS["words"])


def not_contains_word(req: Check) -> DataFrame:
    return _by_words(req, c.value_list(req.param("keywords", "")), labels.REASONS["words"], "regex_not")


def manual_entries(req: Check) -> DataFrame:
    return _by_words(req, c.value_list(req.param("keywords", labels.MANUAL_WORDS)), labels.REASONS["words"])


def suspicious_keywords(req: Check) -> DataFrame:
    words = c.value_list(req.params.get("keywords", labels.SUSPICIOUS_WORDS))
    return _by_words(req, words, labels.REASONS["suspicious_keywords"])


def generic_system_user(req: Check) -> DataFrame:
    words = c.value_list(req.params.get("patterns", labels.GENERIC_USERS))
    return _by_words(req, words, labels.REASONS["generic_system_user"])


def special_chars_description(req: Check) -> DataFrame:
    return _by_text(req, "regex", labels.REASONS["special_chars_description"], labels.SPECIAL_CHARACTERS)


def short_text(req: Check) -> DataFrame:
    return _by_text(req, "len_lt", labels.REASONS["short_text"], req.param("max_len") or req.param("n") or 5)


def listed(req: Check) -> DataFrame:
    values = c.value_list(req.param("values") or req.param("include_values", ""))
    return _by_text(req, "in", f"{req.name} liste kontrolü", values=values)


def exclude_opening(req: Check) -> DataFrame:
    """Keeps rows without an opening/carry-over word; the fold applies to the text, not to the words."""
    words = c.value_list(req.param("exclude_words", labels.OPENING_WORDS)) or labels.OPENING_WORDS
    pattern = c.any_of([w.lower() for w in words])
    opt = req.params.get
    tested = []
    for label, s in text_subjects(req):
        t = c.normalized(s, opt("trim", True), opt("case_sensitive", False), opt("normalize_tr", True))
        tested.append(Tested(label, t.rlike(pattern), s))
    return row_result(req, tested, labels.REASONS["exclude_opening"], lambda masks: ~combine(masks, req.method))


# -- amounts -----------------------------------------------------------------------------


def amount_between(req: Check) -> DataFrame:
    return _by_number(
        req, "between", labels.REASONS["amount_between"], req.param("min_amount", ""), req.param("max_amount", "")
    )


def high_amount(req: Check) -> DataFrame:
    least = req.params.get("min_amount", req.params.get("threshold", 100000))
    return _by_number(req, "gte", labels.REASONS["high_amount"], least)


def negative(req: Check) -> DataFrame:
    threshold = req.param("threshold")
    if threshold is None:
        return _by_number(req, "negative", labels.REASONS["negative"])
    return _by_number(req, "lt", labels.REASONS["negative"], threshold)


def zero(req: Check) -> DataFrame:
    tolerance = abs(req.number("tolerance", 0))
    return _by_number(req, "between", labels.REASONS["zero"], -tolerance, tolerance)


def round_amounts(req: Check) -> DataFrame:
    multiple = abs(req.number("multiple", 1000)) or 1000.0
    least = req.number("min_amount", 0)

    def build(name: str) -> Column:
        x = F.abs(req.num(name)) if req.params.get("absolute", True) else req.num(name)
        return (x >= least) & (F.abs(maths.mod(x, multiple)) <= 1e-9)

    return _by_column(req, build, f"{multiple:g} katı yuvarlak tutar")


def extreme_rows(req: Check) -> DataFrame:
    n = req.param("n", 10)
    return _by_number(req, req.check, f"{req.name} N={n}", n)


# -- dates -------------------------------------------------------------------------------


def _ranged(req: Check, reason: str, outside: bool) -> DataFrame:
    def build(name: str) -> Column:
        inside = p.date_range(
            req.moment(name), req.param("start_date"), req.param("end_date"), req.params.get("ignore_time", True)
        )
        return ~F.coalesce(inside, F.lit(False)) if outside else inside

    return _by_column(req, build, reason)


def date_range(req: Check) -> DataFrame:
    return _ranged(req, labels.REASONS["date_range"], bool(req.params.get("outside", False)))


def date_between(req: Check) -> DataFrame:
    return _ranged(req, labels.REASONS["date_between"], False)


def date_set(req: Check) -> DataFrame:
    days = [c.day(c.date_literal(v)) for v in c.value_list(req.param("date_values", ""))]

    def build(name: str) -> Column:
        return c.day(req.moment(name)).isin(days) if days else F.lit(False)

    return _by_column(req, build, labels.REASONS["date_set"])


def month_end(req: Check) -> DataFrame:
    return _by_column(
        req, lambda n: c.day(req.moment(n)) == F.last_day(req.moment(n)), labels.REASONS["month_end"]
    )


def year_end(req: Check) -> DataFrame:
    return _by_column(
        req,
        lambda n: (F.month(req.moment(n)) == 12) & (F.dayofmonth(req.moment(n)) == 31),
        labels.REASONS["year_end"],
    )


def period_end(req: Check) -> DataFrame:
    given = req.param("period_end")
    end = req.today() if given is None else c.date_literal(given)
    start = F.timestamp_add("DAY", F.lit(-req.whole("days_before", 7)), end)
    stop = F.timestamp_add("DAY", F.lit(req.whole("days_after", 0)), end)
    return _by_column(req, lambda n: req.moment(n).between(start, stop), labels.REASONS["period_end"])


def weekend(req: Check) -> DataFrame:
    return _by_column(req, lambda n: F.weekday(req.moment(n)) >= 5, labels.REASONS["weekend"])


def _minutes(clock: str) -> int:
    return int(clock[:2]) * 60 + int(clock[-2:])


def outside_hours(req: Check, name: str) -> Column:
    """Minute of day before the start or after the end of work; also shifts that cross midnight."""
    start = _minutes(str(req.param("work_start", "08:00")))
    end = _minutes(str(req.param("work_end", "18:00")))
    minute = F.hour(req.moment(name)) * 60 + F.minute(req.moment(name))
    if start <= end:
        return (minute < start) | (minute > end)
    return ~((minute >= start) | (minute <= end))


def after_hours(req: Check) -> DataFrame:
    def build(name: str) -> Column:
        late = outside_hours(req, name)
        if req.params.get("weekend_as_after_hours", True):
            late = late | (F.weekday(req.moment(name)) >= 5)
        return late

    return _by_column(req, build, labels.REASONS["after_hours"])


def after_hours_high_amount(req: Check) -> DataFrame:
    at, amount = req.required("datetime_col"), req.required("amount_col")
    late = outside_hours(req, at) & (F.abs(req.num(amount)) >= req.number("min_amount", 100000))
    tested = [Tested(at, late, _raw(at)), Tested(amount, late, _raw(amount))]
    return row_result(req, tested, labels.REASONS["after_hours_high_amount"], lambda masks: masks[0])


# -- accounts and people -----------------------------------------------------------------


def account_codes(req: Check) -> DataFrame:
    codes = c.value_list(req.params.get("include_accounts", req.params.get("values", "")))
    width = req.whole("prefix_len", 0)
    codes = [v[:width] if width else v for v in codes]
    if codes and all(v.lower() == v.upper() for v in codes):
        # codes without letters: a plain prefix test means the same and can be pushed into the scan
        tested = []
        for label, s in text_subjects(req):
            t = s.cast("string")
            tested.append(Tested(label, reduce(lambda a, b: a | b, [t.startswith(v) for v in codes]), s))
        return row_result(req, tested, labels.REASONS["account_codes"])
    return _by_words(req, codes, labels.REASONS["account_codes"], prefix="^")


def account_range(req: Check) -> DataFrame:
    start, end = req.whole("start_account", 0), req.whole("end_account", 999999999)
    width = req.whole("prefix_len", 3)

    def build(name: str) -> Column:
        digits = F.substring(F.regexp_replace(c.normalized(name), "[^0-9]", ""), 1, width)
        return digits.try_cast("double").between(start, end)

    return _by_column(req, build, labels.REASONS["account_range"])


def _starts_with_any(t: Column, codes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [t.startswith(v.lower()) for v in codes], F.lit(False))


def account_pair(req: Check) -> tuple[str, str | None]:
    return req.required("account_col", 0), req.column("counter_account_col", 1)


def account_combo_text(account: str, counter: str | None) -> Column:
    if counter is None:
        return c.normalized(account)
    return F.concat(c.normalized(account), F.lit(" / "), c.normalized(counter))


def combo_helpers(account: str, counter: str | None) -> dict[str, Column]:
    return {
        "account_combo": account_combo_text(account, counter),
        "match_reason": F.lit(labels.OUTSIDE_EXPECTED),
        "risk_level": F.lit(labels.HIGH),
    }


def unexpected_counter_account(req: Check) -> DataFrame:
    account, counter = account_pair(req)
    main = c.value_list(req.param("accounts") or req.param("main_accounts") or labels.MAIN_ACCOUNTS)
    expected = c.value_list(req.param("expected_accounts", labels.EXPECTED_ACCOUNTS))
    match = _starts_with_any(c.normalized(account), main)
    if counter is not None:
        match = match & ~_starts_with_any(c.normalized(counter), expected)
    return simple_result(req, match, combo_helpers(account, counter))


def creator_approver_same(req: Check) -> DataFrame:
    people = []
    for key in ("creator_col", "approver_col"):
        t = c.normalized(req.required(key))
        if req.params.get("strip_domain", True):
            t = F.regexp_replace(F.regexp_replace(t, r"^.*\\", ""), r"@.*$", "")
        people.append(t)
    match = (people[0] != "") & (people[0] == people[1])
    helpers = {"check_result": F.lit(labels.SAME_PERSON), "risk_level": F.lit(labels.HIGH)}
    return simple_result(req, match, helpers)


def compared_columns(req: Check) -> DataFrame:
    first, *others = [c.normalized(n) for n in req.columns]
    equal = reduce(lambda a, b: a & b, [first == t for t in others])
    match = ~equal if req.params.get("comparison", "different") == "different" else equal
    result = F.when(match, F.lit(labels.COLUMNS_COMPARED)).otherwise(F.lit(""))
    return simple_result(req, match, {"check_result": result})


def debit_credit_split(req: Check) -> DataFrame:
    """Adds debit and credit amounts from one signed column or two columns; keeps every row."""
    if str(req.param("amount_structure", "single")).lower() == "separate":
        d, k = req.required("debit_col"), req.required("credit_col")
        debit, credit = F.coalesce(req.num(d), F.lit(0.0)), F.coalesce(req.num(k), F.lit(0.0))
        note = f"Ayrı kolonlar: {d} / {k}"
    else:
        a = req.required("amount_col")
        x = F.coalesce(req.num(a), F.lit(0.0))
        above, below = F.greatest(x, F.lit(0.0)), F.abs(F.least(x, F.lit(0.0)))
        if str(req.param("single_amount_direction", "positive_debit")).lower() == "negative_debit":
            debit, credit, note = below, above, f"Tek kolon: {a}; negatif=borç, pozitif=alacak"
        else:
            debit, credit, note = above, below, f"Tek kolon: {a}; pozitif=borç, negatif=alacak"
    with_amounts = req.with_df(req.df.withColumns({"CALC_DEBIT": debit, "CALC_CREDIT": credit}))
    helpers = {"check_result": F.lit(labels.SPLIT_DONE), "match_reason": F.lit(note)}
    return simple_result(with_amounts, F.lit(True), helpers)


def journal_risk(req: Check) -> DataFrame:
    """Additive score of amount, description, user and weekend tests."""
    parts = []
    amount, desc = req.column("amount_col"), req.column("description_col")
    user, at = req.column("user_col"), req.column("datetime_col")
    if amount:
        parts.append((F.abs(req.num(amount)) > req.number("high_amount", 100000), req.whole("high_amount_score", 30)))
    if desc:
        parts.append(
            (F.length(c.normalized(desc)) < req.whole("short_desc_len", 5), req.whole("short_desc_score", 15))
        )
    if user:
        generic = c.normalized(user).rlike("|".join(labels.RISK_USERS))
        parts.append((generic, req.whole("generic_user_score", 25)))
    if at:
        parts.append((F.weekday(req.moment(at)) >= 5, req.whole("weekend_score", 20)))
    score = reduce(lambda a, b: a + b, [F.when(t, F.lit(n)).otherwise(F.lit(0)) for t, n in parts], F.lit(0))
    scored = req.with_df(req.df.withColumn("__score", score))
    s = F.col("__score")
    level = (
        F.when(s <= 20, F.lit(labels.LOW))
        .when(s <= 50, F.lit(labels.MEDIUM))
        .when(s <= 80, F.lit(labels.HIGH))
        .otherwise(F.lit(labels.CRITICAL))
    )
    helpers = {"risk_score": s, "risk_level": level, "review_note": F.lit(labels.RISK_NOTE)}
    return simple_result(scored, s >= req.whole("min_score", 20), helpers).drop("__score")


def benford(req: Check) -> DataFrame:
    """Rows whose leading digit is seen more or less often than log10(1 + 1/d) by over 0.08."""
    x = F.abs(req.num(req.columns[0]))
    whole = maths.floor(F.when(x > req.number("min_amount", 0), x))
    shown = F.coalesce(F.when(whole < 1e18, whole.cast("long")).cast("string"), whole.try_cast("decimal(38,0)").cast("string"))
    digit = F.nullif(F.substring(shown, 1, 1), F.lit("0")).cast("int")
    # nine counts at most, so the shares fit a one-row map; the subquery keeps the deviating digits
    counts = req.source.select(digit.alias("digit")).filter("digit is not null").groupBy("digit").count()
    one = counts.agg(
        F.map_from_entries(F.collect_list(F.struct("digit", "count"))).alias("rows"), F.sum("count").alias("total")
    ).select(F.transform_values("rows", lambda _, n: n / F.col("total")).alias("shares"))
    risky = one.select(
        F.map_filter("shares", lambda d, share: F.abs(share - F.log10(1 + F.lit(1.0) / d)) > 0.08).alias("risky")
    ).scalar()
    df = req.df.withColumn("__digit", digit)
    share = F.try_element_at(risky, F.col("__digit"))
    match = share.isNotNull()
    helpers = {"digit_share": F.coalesce(share, F.lit(0.0)), "risk_level": F.lit(labels.MEDIUM)}
    return simple_result(req.with_df(df), match, helpers).drop("__digit")
