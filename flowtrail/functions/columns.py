"""Column expressions shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(20,6)"


def node_id(bank: str, account: str) -> Column:
    """``bank-account``; NULL when either part is NULL."""
    return F.concat(F.col(bank), F.lit("-"), F.col(account))


def amount_key(amount: str) -> Column:
    """Exact equality key for a float amount (six decimals)."""
    return F.round(F.col(amount), 6).cast(MONEY)


def money_sum(amount) -> Column:
    """Exact, order-independent sum of a float amount with up to six decimals.

    Whole units and millionths are summed as two integers, so the result does not depend
    on how rows are spread over tasks and costs no decimal arithmetic per row.
    """
    col = F.col(amount) if isinstance(amount, str) else amount
    whole = F.floor(col)
    millionths = F.round((col - whole) * 1_000_000).cast("bigint")
    return F.sum(whole) + F.sum(millionths) / F.lit(1_000_000.0)


def hours_between(start, end) -> Column:
    a = F.col(start) if isinstance(start, str) else start
    b = F.col(end) if isinstance(end, str) else end
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(3.6e9)


def beside(base: DataFrame, *single: DataFrame) -> DataFrame:
    """Add the columns of one-row tables to every row, as scalar subqueries."""
    for one in single:
        # One subquery per table, however many columns it has.
        packed = base.withColumn("_one", one.select(F.struct(*one.columns)).scalar())
        base = packed.select(*base.columns, *[F.col("_one")[c].alias(c) for c in one.columns])
    return base


def account_set(col: Column) -> Column:
    """Canonical form of a set of accounts: distinct, ascending."""
    return F.array_sort(F.array_distinct(col))


def ratio_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def evidence(**fields: Column) -> Column:
    """The evidence struct with the named fields filled and the rest NULL."""
    from flowtrail.schema import EVIDENCE

    return F.struct(
        *[
            (fields[f.name] if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in EVIDENCE.fields
        ]
    )
