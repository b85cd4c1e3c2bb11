"""Double-entry journal and ledger processing as Spark DataFrame operators."""

from ledgerloom.session import build_session

__all__ = ["build_session"]
