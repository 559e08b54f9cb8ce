"""Ready-made audit checks by id, their complement, AND/OR chains and result counts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerscan.functions.defaults import fill_defaults
from ledgerscan.operators.checks import group_checks as g
from ledgerscan.operators.checks import row_checks as r
from ledgerscan.operators.checks.base import HELPER_COLUMNS, MATCH, Check
from ledgerscan.operators.preview import page
from ledgerscan.plans.tables import written

CHECKS: dict[str, Callable[[Check], DataFrame]] = {
    "empty": r.empty,
    "empty_document": r.empty,
    "empty_description": r.empty,
    "not_empty": r.not_empty,
    "contains_word": r.contains_word,
    "not_contains_word": r.not_contains_word,
    "manual_entries": r.manual_entries,
    "special_chars_description": r.special_chars_description,
    "amount_between": r.amount_between,
    "high_amount": r.high_amount,
    "date_range": r.date_range,
    "date_between": r.date_between,
    "date_set": r.date_set,
    "month_end": r.month_end,
    "year_end": r.year_end,
    "period_end": r.period_end,
    "weekend": r.weekend,
    "after_hours": r.after_hours,
    "after_hours_high_amount": r.after_hours_high_amount,
    "negative": r.negative,
    "zero": r.zero,
    "round_amounts": r.round_amounts,
    "top_n": r.extreme_rows,
    "bottom_n": r.extreme_rows,
    "random_n": r.extreme_rows,
    "duplicates": g.duplicates,
    "unique": g.duplicates,
    "duplicate_amount": g.duplicate_amount,
    "same_day_same_amount": g.same_day_same_amount,
    "duplicate_invoice_payment": g.repeated_invoice,
    "reversal_check": g.repeated_invoice,
    "document_sequence_gap": g.document_sequence_gap,
    "rare_user_transactions": g.rare_user_transactions,
    "user_intensity": g.user_intensity,
    "account_codes": r.account_codes,
    "account_groups": r.account_codes,
    "account_prefix": r.account_codes,
    "account_range": r.account_range,
    "short_text": r.short_text,
    "suspicious_keywords": r.suspicious_keywords,
    "generic_system_user": r.generic_system_user,
    "voucher": r.listed,
    "users": r.listed,
    "exclude_opening": r.exclude_opening,
    "revenue_counter_account": r.unexpected_counter_account,
    "opex_counter_account": r.unexpected_counter_account,
    "inventory_counter_account": r.unexpected_counter_account,
    "asset_account_control": r.unexpected_counter_account,
    "unusual_account_combo": r.unexpected_counter_account,
    "rare_account_combo": g.rare_account_combo,
    "split_transaction": g.split_transaction,
    "single_leg_voucher": g.single_leg_voucher,
    "debit_credit_imbalance": g.debit_credit_imbalance,
    "debit_credit_split": r.debit_credit_split,
    "creator_approver_same": r.creator_approver_same,
    "benford": r.benford,
    "journal_risk": r.journal_risk,
}

# Checks that compare a row with other rows.
WHOLE_TABLE = {
    "top_n",
    "bottom_n",
    "random_n",
    "duplicates",
    "unique",
    "duplicate_amount",
    "same_day_same_amount",
    "duplicate_invoice_payment",
    "reversal_check",
    "document_sequence_gap",
    "rare_user_transactions",
    "user_intensity",
    "rare_account_combo",
    "split_transaction",
    "single_leg_voucher",
    "debit_credit_imbalance",
    "benford",
}

# Checks whose columns all come from parameters.
WITHOUT_COLUMNS = {
    "journal_risk",
    "debit_credit_split",
    "debit_credit_imbalance",
    "split_transaction",
    "single_leg_voucher",
    "creator_approver_same",
    "user_intensity",
    "same_day_same_amount",
    "after_hours_high_amount",
}


def annotate(
    df: DataFrame,
    check: str,
    columns: Sequence[str] | str = (),
    method: str | None = None,
    name: str | None = None,
    helpers: bool = True,
    order_by: Sequence[str] = (),
    as_of=None,
    matched_only: bool = False,
    base: DataFrame | None = None,
    **params,
) -> DataFrame:
    """All rows of ``df`` with the boolean ``__match`` and the helper columns of the check.

    ``matched_only`` lets a grouped check drop the other rows early; ``base`` is the plain table whose
    rows ``df`` annotates, so that statistics need not go through earlier annotations.
    """
    if check not in CHECKS:
        raise ValueError(f"Unsupported check: {check}")
    columns = [columns] if isinstance(columns, str) else list(columns)
    columns = [n for n in columns if n in df.columns]
    if not columns and check not in WITHOUT_COLUMNS:
        raise ValueError(f"{check}: choose at least one column")
    request = Check(
        df, check, columns, method or params.get("column_method") or "any", name or check, helpers, order_by, as_of,
        matched_only, params, base,
    )
    if request.method == "compare_columns" and len(columns) >= 2:
        return r.compared_columns(request)
    return CHECKS[check](request)


def run_check(df: DataFrame, check: str, columns: Sequence[str] | str = (), scope: str = "matched", **kwargs):
    """Rows that a check returns (``matched``, with helper columns) or leaves (``unmatched``)."""
    if scope == "matched":
        return annotate(df, check, columns, matched_only=True, **kwargs).filter(MATCH).drop(MATCH)
    kwargs["helpers"] = False
    return annotate(df, check, columns, **kwargs).filter(~F.col(MATCH)).select(*[F.col(f"`{n}`") for n in df.columns])


def chain_and(df: DataFrame, checks: Sequence[dict]) -> DataFrame:
    """Checks one after another: a later check sees only the rows left by the earlier ones.

    A check over the whole table reads its input twice. After an earlier one of that kind the rows
    left so far are written first, so that a long chain does not repeat its beginning.
    """
    if not checks:
        raise ValueError("The check chain is empty")
    joined = False
    for spec in checks:
        if spec["check"] in WHOLE_TABLE:
            if joined:
                df = written(df)
            joined = True
        df = run_check(df, **spec)
    return df


def chain_or(df: DataFrame, checks: Sequence[dict]) -> DataFrame:
    """Rows returned by any check, once each, explained by the first check that returned them."""
    if not checks:
        raise ValueError("The check chain is empty")
    out, marks, explained = df, [], {}
    for i, spec in enumerate(checks):
        out = annotate(out, base=df, **spec)
        mark = f"__hit{i}"
        marks.append(F.col(mark))
        out = out.withColumnRenamed(MATCH, mark)
        for helper in HELPER_COLUMNS:
            if helper in out.columns and helper not in df.columns:
                out = out.withColumnRenamed(helper, f"__{i}_{helper}")
                explained.setdefault(helper, {})[i] = F.col(f"__{i}_{helper}")
    hit_first = F.coalesce(*[F.when(m, F.lit(i)) for i, m in enumerate(marks)])
    out = out.withColumn("__first_hit", hit_first).filter("__first_hit is not null")
    helpers = [
        F.coalesce(*[F.when(F.col("__first_hit") == i, h) for i, h in per_check.items()]).alias(helper)
        for helper, per_check in explained.items()
    ]
    return out.select(*[F.col(f"`{n}`") for n in df.columns], *helpers)


def result_counts(df: DataFrame, check: str, columns: Sequence[str] | str = (), **kwargs) -> DataFrame:
    """One row: total, matched and excluded rows."""
    kwargs["helpers"] = False
    marked = annotate(df, check, columns, **kwargs)
    return marked.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(MATCH).alias("result_rows"),
        F.count_if(~F.col(MATCH)).alias("excluded_rows"),
    )


def result_sample(df: DataFrame, check: str, columns: Sequence[str] | str = (), limit: int = 50, **kwargs) -> DataFrame:
    """The first ``limit`` rows of a result with its explanations, missing values filled as in exports.

    The rows come in the order of ``order_by`` and, in a tie, of their whole content.
    """
    found = run_check(df, check, columns, **kwargs)
    rows, _ = page(found, per=limit, order_by=kwargs.get("order_by") or ())
    return fill_defaults(rows)
