"""Money, ratio and text columns.

Money rounds half away from zero; ratios round half to even.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from purseflow.schemas import INBOUND, TOTAL


def money(value: Column) -> Column:
    """Two decimals, half-up."""
    return F.round(value, 2).cast(TOTAL)


def money_sum(value: Column) -> Column:
    """Sum of money, 0 for no rows."""
    return F.coalesce(F.sum(value), F.lit(0)).cast(TOTAL)


def ratio(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """Half-even quotient; 0 unless the denominator is above 0."""
    kind = f"decimal(20,{digits})"
    quotient = F.bround(numerator.cast(TOTAL) / denominator.cast(TOTAL), digits).cast(kind)
    return F.when(denominator > 0, quotient).otherwise(F.lit(0).cast(kind))


def inbound(amount: Column, direction: str = "direction") -> Column:
    return F.when(F.col(direction) == INBOUND, amount)


def outbound(amount: Column, direction: str = "direction") -> Column:
    return F.when(F.col(direction) != INBOUND, amount)


def signed(amount: Column, direction: str = "direction") -> Column:
    return F.when(F.col(direction) == INBOUND, amount).otherwise(-amount)


def percent_text(rate: Column) -> Column:
    """0.35 -> '35%'."""
    return F.concat(F.bround(rate * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def amount_text(value: Column, digits: int = 2) -> Column:
    """Fixed-point text, half-even as number formatting does."""
    return F.bround(value, digits).cast(f"decimal(24,{digits})").cast("string")


def currency_code(value: Column) -> Column:
    return F.upper(value)
