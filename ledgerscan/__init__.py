"""Ledger-audit analytics as ordinary PySpark DataFrame transformations."""

from ledgerscan.session import build_session

__all__ = ["build_session"]
