"""Checks that decide from all rows sharing a key: duplicates, vouchers, users, account pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerscan.functions import coerce as c
from ledgerscan.functions import maths
from ledgerscan.operators.checks import labels
from ledgerscan.operators.checks.base import Check, grouped_result, text_key
from ledgerscan.operators.checks.row_checks import account_combo_text, account_pair, combo_helpers
from ledgerscan.plans.exact import group_sums
from ledgerscan.plans.keyed import order_key


def _weight() -> Column:
    """Rows of the key."""
    return F.col("__weight")


def _order(req: Check) -> Column:
    if not req.order_by:
        raise ValueError(f"{req.check}: keep_mode needs order_by columns that identify a row")
    return order_key(req.order_by)


def _rounded(req: Check, name: str) -> Column:
    """Amount as key text, rounded half-even; a missing amount is the empty key."""
    digits = req.whole("decimal_precision", 2)
    return F.coalesce(maths.half_even(req.num(name), digits).cast("string"), F.lit(""))


def duplicates(req: Check) -> DataFrame:
    opt = req.params.get
    texts = [
        c.normalized(n, opt("trim", True), opt("case_sensitive", False), opt("normalize_tr", False))
        for n in req.columns
    ]
    if req.check == "unique":
        condition, word = _weight() == 1, labels.SINGLE
    else:
        condition, word = (_weight() > 1) & (_weight() >= req.whole("min_count", 2)), labels.DUPLICATE
    aggs, others = {}, None
    if req.check == "duplicates" and req.param("keep_mode") in ("second", "first"):
        pick = F.min if req.param("keep_mode") == "second" else F.max
        aggs["__spared"] = pick(_order(req))
        others = _order(req) != F.col("__spared")
    helpers = {"group_count": _weight(), "check_result": F.lit(word)}
    return grouped_result(req, text_key(texts), aggs, condition, helpers, others, numbered=True)


def duplicate_amount(req: Check) -> DataFrame:
    key = text_key([_rounded(req, n) for n in req.columns])
    return grouped_result(req, key, {}, _weight() >= req.whole("min_count", 2), {"group_count": _weight()}, numbered=True)


def same_day_same_amount(req: Check) -> DataFrame:
    at, amount = req.required("date_col"), req.required("amount_col")
    key = text_key([c.text(c.day(req.moment(at))), _rounded(req, amount)])
    return grouped_result(req, key, {}, _weight() >= req.whole("min_count", 2), {"group_count": _weight()}, numbered=True)


def repeated_invoice(req: Check) -> DataFrame:
    """Repeated key of document, partner and amount; the reversal check pairs +x with -x."""
    named = [req.column(k) for k in ("invoice_col", "document_col", "supplier_col", "amount_col")]
    columns = req.columns or [n for n in named if n]
    if not columns:
        raise ValueError(f"{req.check}: key columns are missing")
    parts = []
    for n in columns:
        if n == req.param("amount_col") or n.lower() in labels.AMOUNT_NAMES:
            if req.check == "reversal_check":
                parts.append(c.text(F.abs(req.num(n))))
            else:
                parts.append(_rounded(req, n))
        else:
            parts.append(c.normalized(n))
    helpers = {"group_count": _weight(), "risk_level": F.lit(labels.HIGH)}
    return grouped_result(req, text_key(parts), {}, _weight() >= req.whole("min_count", 2), helpers, numbered=True)


def document_sequence_gap(req: Check) -> DataFrame:
    """Blank or repeated document numbers."""
    t = c.normalized(req.required("document_col", 0))
    helpers = {
        "group_count": _weight(),
        "check_result": F.lit(labels.BAD_DOCUMENT),
        "risk_level": F.lit(labels.MEDIUM),
    }
    blank = {"__blank": F.max(t == "")}
    return grouped_result(req, {"__key": t}, blank, F.col("__blank") | (_weight() > 1), helpers)


def rare_user_transactions(req: Check) -> DataFrame:
    key = text_key([c.normalized(n) for n in req.columns])
    helpers = {"group_count": _weight(), "risk_level": F.lit(labels.MEDIUM)}
    return grouped_result(req, key, {}, _weight() <= req.whole("max_count", 3), helpers)


def user_intensity(req: Check) -> DataFrame:
    user, amount = req.required("user_col", 0), req.column("amount_col")
    condition, aggs = _weight() >= req.whole("min_count", 100), {}
    if amount and req.param("amount_threshold") is not None:
        aggs["__sum"] = F.sum(F.abs(req.num(amount)))
        condition = condition | F.coalesce(F.col("__sum") >= req.number("amount_threshold", 0), F.lit(False))
    helpers = {
        "check_result": F.lit(labels.USER_INTENSITY),
        "group_count": _weight(),
        "risk_level": F.lit(labels.MEDIUM),
    }
    return grouped_result(req, {"__key": c.normalized(user)}, aggs, condition, helpers)


def rare_account_combo(req: Check) -> DataFrame:
    account, counter = account_pair(req)
    key = {"__key": account_combo_text(account, counter)}
    condition = _weight() <= req.whole("max_count", 1)
    return grouped_result(req, key, {}, condition, combo_helpers(account, counter))


def split_transaction(req: Check) -> DataFrame:
    """Amounts below the limit whose group (supplier, user, account, day) reaches it."""
    amount = req.required("amount_col", 0)
    limit = req.number("limit_amount", 100000)
    parts = [c.text(n) for n in (req.column("supplier_col"), req.column("user_col"), req.column("account_col")) if n]
    if req.column("date_col"):
        parts.append(c.text(c.day(req.moment(req.column("date_col")))))
    if not parts:
        raise ValueError("split_transaction: at least one group column is needed")
    size = F.abs(req.num(amount))
    condition = (F.col("__sum") >= limit) & (_weight() >= req.whole("min_parts", 2))
    helpers = {"group_total": F.col("__sum"), "risk_level": F.lit(labels.HIGH)}
    total = {"__sum": F.coalesce(F.sum(size), F.lit(0.0))}
    return grouped_result(req, text_key(parts), total, condition, helpers, size < limit, numbered=True)


def _voucher_totals(req: Check, voucher: str, debit: str, credit: str) -> DataFrame:
    """Rows, debit, credit and their difference of every voucher, exact at every size."""
    values = {"__debit": req.num(debit), "__credit": req.num(credit)}
    totals = {"__debit": {"__debit": 1}, "__credit": {"__credit": 1}, "__gap": {"__debit": 1, "__credit": -1}}
    return group_sums(req.source, {"__key": F.col(f"`{voucher}`")}, values, totals)


def single_leg_voucher(req: Check) -> DataFrame:
    voucher = req.required("voucher_col")
    debit, credit = req.column("debit_col"), req.column("credit_col")
    condition, stats = _weight() <= req.whole("min_rows", 1), None
    if debit and credit:
        stats = _voucher_totals(req, voucher, debit, credit)
        d, k = F.col("__debit"), F.col("__credit")
        condition = condition | ((d > 0) & (k == 0)) | ((k > 0) & (d == 0))
    helpers = {"check_result": F.lit(labels.SINGLE_LEG), "risk_level": F.lit(labels.HIGH)}
    return grouped_result(req, {"__key": F.col(f"`{voucher}`")}, {}, condition, helpers, stats=stats)


def debit_credit_imbalance(req: Check) -> DataFrame:
    voucher = req.required("voucher_col", 0)
    debit, credit = req.required("debit_col"), req.required("credit_col")
    stats, gap = _voucher_totals(req, voucher, debit, credit), F.col("__gap")
    condition = F.abs(gap) > F.lit(req.number("tolerance", 0))
    helpers = {
        "debit_total": F.col("__debit"),
        "credit_total": F.col("__credit"),
        "difference": gap,
        "risk_level": F.when(F.abs(gap) > 1000, F.lit(labels.HIGH)).otherwise(F.lit(labels.MEDIUM)),
    }
    return grouped_result(req, {"__key": F.col(f"`{voucher}`")}, {}, condition, helpers, stats=stats)
