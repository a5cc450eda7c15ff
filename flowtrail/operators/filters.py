"""Row selections over transfers and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def without_self_payments(transfers: DataFrame) -> DataFrame:
    return transfers.where(F.col("from_node") != F.col("to_node"))


def self_payments(transfers: DataFrame) -> DataFrame:
    return transfers.where(F.col("from_node") == F.col("to_node"))


def search_slice(transfers: DataFrame, rails: tuple[str, ...] = ("ACH",)) -> DataFrame:
    """The transfers detection looks at; no rails means every rail."""
    rows = without_self_payments(transfers)
    return rows.where(F.col("payment_format").isin(*rails)) if rails else rows


def induced_transfers(transfers: DataFrame, nodes: DataFrame, column: str = "node") -> DataFrame:
    """Transfers with both endpoints in a node table."""
    keep = nodes.select(F.col(column).alias("_n")).distinct()
    return transfers.join(keep, F.col("from_node") == F.col("_n"), "left_semi").join(
        keep, F.col("to_node") == F.col("_n"), "left_semi"
    )


def volume_capped(accounts: DataFrame, cap: int) -> DataFrame:
    """Accounts that both receive and send, at most ``cap`` transfers each way."""
    return accounts.where(F.col("in_rows").between(1, cap) & F.col("out_rows").between(1, cap))


def size_guard(candidates: DataFrame, max_accounts: int) -> DataFrame:
    return candidates.where(F.size("accounts") <= max_accounts)
