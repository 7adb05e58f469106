"""Ledger rows: filters, listings, category names, running balances per transaction, checks."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from purseflow.functions.money import signed
from purseflow.functions.periods import as_day
from purseflow.operators.skew import lookup_join, running_sum, top_k
from purseflow.schemas import INBOUND, MONTH_COLUMN, OUTBOUND, REGION_CURRENCY

UNCATEGORIZED = "Uncategorized"
LIST_LIMIT = 500
RECENT_EXPENSES = 20


def filter_transactions(
    tx: DataFrame,
    start: Column | date | str | None = None,
    end: Column | date | str | None = None,
    region: str | None = None,
    direction: str | None = None,
) -> DataFrame:
    """Inclusive dates, region and direction; a NULL region never matches a region filter.

    Date bounds are repeated on the month partitions where the table has them, so whole months
    are skipped.
    """
    by_month = MONTH_COLUMN in tx.columns
    if start is not None:
        tx = tx.filter(F.col("occurred_on") >= as_day(start))
        if by_month:
            tx = tx.filter(F.col(MONTH_COLUMN) >= F.trunc(as_day(start), "month"))
    if end is not None:
        tx = tx.filter(F.col("occurred_on") <= as_day(end))
        if by_month:
            tx = tx.filter(F.col(MONTH_COLUMN) <= F.trunc(as_day(end), "month"))
    if region is not None:
        tx = tx.filter(F.col("region") == region)
    if direction is not None:
        tx = tx.filter(F.col("direction") == direction)
    return tx


def listed(
    start: Column | date | str | None = None,
    end: Column | date | str | None = None,
    region: str | None = None,
    direction: str | None = None,
) -> Column:
    """The condition of ``filter_transactions``, without the month partitions."""
    tests = [F.lit(True)]
    if start is not None:
        tests.append(F.col("occurred_on") >= as_day(start))
    if end is not None:
        tests.append(F.col("occurred_on") <= as_day(end))
    if region is not None:
        tests.append(F.col("region") == region)
    if direction is not None:
        tests.append(F.col("direction") == direction)
    return reduce(lambda a, b: a & b, tests)


def newest_first() -> list[Column]:
    return [F.desc("occurred_on"), F.desc_nulls_last("occurred_time"), F.desc("id")]


def oldest_first(midnight: str = "00:00:00") -> list[Column]:
    """Ledger order; rows without a time of day count as midnight."""
    return [F.col("occurred_on"), F.coalesce("occurred_time", F.lit(midnight)), F.col("id")]


def list_transactions(tx: DataFrame, limit: int = LIST_LIMIT, **filters) -> DataFrame:
    """The newest rows of every user, numbered from 1 in ``position``."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    rows = filter_transactions(tx, **filters)
    return top_k(rows, ["user_id"], newest_first(), limit, spread_by="id", rank="position")


def list_categories(
    categories: DataFrame, direction: str | None = None, include_statutory: bool = True
) -> DataFrame:
    if direction is not None:
        categories = categories.filter(F.col("direction") == direction)
    if not include_statutory:
        categories = categories.filter(~F.col("statutory"))
    return categories.orderBy("direction", "name")


def with_category(df: DataFrame, categories: DataFrame, **columns: str) -> DataFrame:
    """Rows with columns of their category, given as new name = stored name; NULL without one.

    Few categories hold most rows, and users add categories: the join stays even for both.
    """
    picked = [F.col(stored).alias(name) for name, stored in columns.items()]
    common = None
    if "is_system" in categories.columns:
        picked.append(F.coalesce("is_system", F.lit(False)).alias("_system"))
        common = F.col("_system")
    wanted = categories.select(F.col("id").alias("category_id"), *picked)
    joined = lookup_join(df, wanted, ["category_id"], counted=categories, common=common)
    return joined.drop("_system")


def with_category_name(
    df: DataFrame, categories: DataFrame, missing: str = UNCATEGORIZED
) -> DataFrame:
    named = with_category(df, categories, _name="name")
    return named.withColumn("category_name", F.coalesce("_name", F.lit(missing))).drop("_name")


def region_currency(region: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for code, currency in REGION_CURRENCY.items():
        chosen = F.when(region == code, currency).otherwise(chosen)
    return chosen


def write_currency(given: Column, region: Column, base: Column) -> Column:
    """Currency of a new row: the given one, else the region's, else the user's base."""
    return F.coalesce(F.upper(F.nullif(given, F.lit(""))), region_currency(region), base)


def read_currency(given: Column, base: Column) -> Column:
    """Display currency of a report: the given one, else the user's base."""
    return F.upper(F.coalesce(F.nullif(given, F.lit("")), base))


def running_balance_by_transaction(
    converted: DataFrame, region: str | None = None, newest: tuple[Column, int] | None = None
) -> DataFrame:
    """Balance after each transaction over the user's full history.

    With ``newest``, only rows of the days that hold each user's newest rows of interest.
    """
    rows = filter_transactions(converted, region=region)
    return running_sum(
        rows,
        "user_id",
        "occurred_on",
        oldest_first(),
        signed(F.col("amt")),
        "balance",
        newest=newest,
    )


def ledger_view(
    converted: DataFrame,
    categories: DataFrame,
    limit: int = LIST_LIMIT,
    region: str | None = None,
    **filters,
) -> DataFrame:
    """Newest rows with category name and running balance.

    The balance is over the full history; days before the ones that the listing reaches are
    added up and not sorted.
    """
    with_balance = running_balance_by_transaction(converted, region, (listed(**filters), limit))
    return with_category_name(list_transactions(with_balance, limit, **filters), categories)


def expense_deltas(tx: DataFrame, n: int = RECENT_EXPENSES, **filters) -> DataFrame:
    """The last n expenses of each user in time order, with the change from the one before."""
    expenses = filter_transactions(tx, direction=OUTBOUND, **filters)
    day, time, key = oldest_first("00:00")
    recent = top_k(expenses, ["user_id"], [day.desc(), time.desc(), key.desc()], n)
    line = Window.partitionBy("user_id").orderBy(F.desc("_rank"))
    change = F.col("amount") - F.lag("amount").over(line)
    return recent.withColumn("delta", change.cast("decimal(18,2)")).drop("_rank")


# ------------------------------------------------------------------------------- row checks


def with_direction_reason(tx: DataFrame, categories: DataFrame) -> DataFrame:
    """Why a row may not enter the ledger, in ``reason``; NULL for good rows."""
    sided = with_category(tx, categories, _side="direction")
    reason = (
        F.when(F.col("amount") <= 0, "amount must be positive")
        .when(F.col("_side").isNull(), "category not found")
        .when(F.col("_side") != F.col("direction"), "direction mismatch")
    )
    return sided.withColumn("reason", reason).drop("_side")


def with_budget_reason(budgets: DataFrame, categories: DataFrame) -> DataFrame:
    """Why a budget is refused, in ``reason``; NULL for good rows."""
    sided = with_category(budgets, categories, _side="direction")
    not_expense = F.coalesce(F.col("_side"), F.lit(INBOUND)) != OUTBOUND
    reason = (
        F.when(F.col("limit_amount") <= 0, "limit must be positive")
        .when(~F.col("month").between(1, 12), "month out of range")
        .when(not_expense, "not an expense category")
    )
    return sided.withColumn("reason", reason).drop("_side")


def direction_rejects(tx: DataFrame, categories: DataFrame) -> DataFrame:
    return with_direction_reason(tx, categories).filter(F.col("reason").isNotNull())


def budget_rejects(budgets: DataFrame, categories: DataFrame) -> DataFrame:
    return with_budget_reason(budgets, categories).filter(F.col("reason").isNotNull())
