"""Income and expense reports over converted transactions (``fx.to_display`` adds ``amt``)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from purseflow.functions.money import inbound, money, money_sum, outbound, ratio
from purseflow.functions.periods import (
    DAYS_PER_MONTH,
    month_key,
    month_start,
)
from purseflow.operators.ledger import filter_transactions, with_category, with_category_name
from purseflow.operators.skew import dealt, top_k
from purseflow.schemas import INBOUND, OUTBOUND

TOP_CATEGORIES = 5


def _flows(*names: str) -> list[Column]:
    """Income, expense and net sums of a group under the given names."""
    income, expense = money_sum(inbound(F.col("amt"))), money_sum(outbound(F.col("amt")))
    return [
        income.alias(names[0]),
        expense.alias(names[1]),
        money(income - expense).alias(names[2]),
    ]


def totals(converted: DataFrame) -> DataFrame:
    return converted.groupBy("user_id").agg(*_flows("total_income", "total_expense", "net_cashflow"))


def per_category_totals(converted: DataFrame, categories: DataFrame) -> DataFrame:
    """Total per (user, category); the direction is that of the first row.

    The direction travels as a boolean, so the aggregate hashes instead of sorting; names join
    after the aggregation.
    """
    grouped = converted.groupBy("user_id", "category_id").agg(
        money_sum(F.col("amt")).alias("total"),
        F.min_by(F.col("direction") == INBOUND, "id").alias("_inbound"),
    )
    side = F.when(F.col("_inbound"), INBOUND).otherwise(OUTBOUND)
    sided = grouped.withColumn("direction", side).drop("_inbound")
    return with_category_name(sided, categories)


def top_expense_categories(category_totals: DataFrame, k: int = TOP_CATEGORIES) -> DataFrame:
    expenses = category_totals.filter(F.col("direction") == OUTBOUND)
    return top_k(expenses, ["user_id"], [F.desc("total"), F.col("category_id")], k, rank="rank")


def _check_months(months: int) -> None:
    if months < 1:
        raise ValueError("months must be at least 1")


def monthly_totals(converted: DataFrame, months: int = 6) -> DataFrame:
    """The last ``months`` months that have data; gaps are not filled."""
    _check_months(months)
    by_month = converted.groupBy("user_id", month_start(F.col("occurred_on")).alias("_month")).agg(
        *_flows("income", "expense", "net")
    )
    kept = top_k(by_month, ["user_id"], [F.desc("_month")], months)
    return kept.select(
        "user_id", month_key(F.col("_month")).alias("month"), "income", "expense", "net"
    )


def monthly_expenses(converted: DataFrame) -> DataFrame:
    """Expense per user, category and month, staged and dealt by user for the grids.

    The exchange sizes its tasks by rows, as a grid may make a few dozen of each.
    """
    spent = (
        filter_transactions(converted, direction=OUTBOUND)
        .groupBy("user_id", "category_id", month_start(F.col("occurred_on")).alias("_month"))
        .agg(money_sum(F.col("amt")).alias("_value"))
    )
    return dealt(spent, ["user_id"], "monthly-expenses")


def monthly_expense_by_category(
    converted: DataFrame, categories: DataFrame, months: int = 6, spent: DataFrame | None = None
) -> DataFrame:
    """Dense (user, category, month) expense grid over the last months with expenses.

    The month list of a user (at most 36) rides along as an array and is unfolded per category,
    so no pair join is needed and everything after one exchange stays on ``user_id``. Grids of the
    same rows may share their ``spent``, the ``monthly_expenses``.
    """
    _check_months(months)
    newest = Window.partitionBy("user_id").orderBy(F.desc("_month"))
    by_user = monthly_expenses(converted) if spent is None else spent
    kept = by_user.withColumn("_age", F.dense_rank().over(newest)).filter(F.col("_age") <= months)
    user = Window.partitionBy("user_id")
    listed = kept.withColumn("_months", F.array_sort(F.collect_set("_month").over(user)))
    rows = (
        listed.groupBy("user_id", "category_id")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("_month", "_value"))).alias("_values"),
            F.first("_months").alias("_months"),
        )
        .withColumn("_month", F.explode("_months"))
    )
    value = F.coalesce(F.try_element_at("_values", F.col("_month")), F.lit(0)).cast("decimal(18,2)")
    grid = rows.select(
        "user_id", "category_id", month_key(F.col("_month")).alias("month"), value.alias("value")
    )
    return with_category_name(grid, categories)


def monthly_series(grid: DataFrame) -> DataFrame:
    """The grid as one row per category with aligned month and value arrays."""
    points = F.array_sort(F.collect_list(F.struct("month", "value")))
    return (
        grid.groupBy("user_id", "category_id", "category_name")
        .agg(points.alias("_points"))
        .select(
            "user_id",
            "category_id",
            "category_name",
            F.col("_points.month").alias("months"),
            F.col("_points.value").alias("values"),
        )
    )


def top_plus_other(grid: DataFrame, k: int = TOP_CATEGORIES) -> DataFrame:
    """The grid with the k largest categories kept and the rest added up as "Other"."""
    user_category = Window.partitionBy("user_id", "category_id")
    ranked = grid.withColumn("_total", F.sum("value").over(user_category)).withColumn(
        "_rank",
        F.dense_rank().over(
            Window.partitionBy("user_id").orderBy(F.desc("_total"), F.col("category_id"))
        ),
    )
    top = F.col("_rank") <= k
    return (
        ranked.groupBy(
            "user_id",
            F.when(top, F.col("category_id")).alias("category_id"),
            F.when(top, F.col("category_name")).otherwise("Other").alias("label"),
            "month",
        )
        .agg(money_sum(F.col("value")).alias("value"))
    )


def daily_totals(converted: DataFrame) -> DataFrame:
    return converted.groupBy("user_id", "occurred_on").agg(*_flows("income", "expense", "net"))


def running_balance(converted: DataFrame, start=None, end=None, region=None) -> DataFrame:
    """Daily totals and their cumulative balance from the start of the range.

    Rows are added up per day before the window, which then sees at most one row per user and
    calendar day.
    """
    days = daily_totals(filter_transactions(converted, start, end, region))
    line = (
        Window.partitionBy("user_id")
        .orderBy("occurred_on")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return days.withColumn("balance", F.sum("net").over(line).cast("decimal(18,2)"))


def balance_at(converted: DataFrame, until: Column | date | None = None) -> DataFrame:
    """All-time balance of each user up to a day: a plain sum, no window."""
    rows = converted if until is None else filter_transactions(converted, end=until)
    flow = money_sum(inbound(F.col("amt"))) - money_sum(outbound(F.col("amt")))
    return rows.groupBy("user_id").agg(money(flow).alias("balance"))


def last_balances(users: DataFrame, converted: DataFrame, start=None, end=None) -> DataFrame:
    """Closing balance over all dates and over the period, 0 without rows; one pass over the rows."""
    within = F.lit(True)
    if start is not None:
        within = within & (F.col("occurred_on") >= F.lit(start))
    if end is not None:
        within = within & (F.col("occurred_on") <= F.lit(end))
    flow = F.when(F.col("direction") == INBOUND, F.col("amt")).otherwise(-F.col("amt"))
    closing = converted.groupBy("user_id").agg(
        money_sum(flow).alias("global_balance"),
        money_sum(F.when(within, flow)).alias("period_balance"),
    )
    return users.select(F.col("id").alias("user_id")).join(closing, "user_id", "left").fillna(
        0, ["global_balance", "period_balance"]
    )


def prior_period_delta(
    category_totals: DataFrame, previous_totals: DataFrame
) -> DataFrame:
    """Relative change of each expense category against the prior period, matched by name.

    NULL without a positive prior total. Two categories that share a name show the total of the
    one with the highest id as the prior value.
    """
    now = category_totals.filter(F.col("direction") == OUTBOUND)
    before = (
        previous_totals.filter(F.col("direction") == OUTBOUND)
        .groupBy("user_id", "category_name")
        .agg(F.max_by("total", "category_id").alias("previous_total"))
    )
    previous = F.col("previous_total").cast("double")
    change = F.when(previous > 0, (F.col("total").cast("double") - previous) / previous)
    return now.join(before, ["user_id", "category_name"], "left").withColumn("change", change)


def savings_rate(reference: Column, expense: Column) -> Column:
    """(reference - expense) / reference; 0 without a positive reference."""
    kept = F.coalesce(reference, F.lit(0).cast("decimal(18,2)"))
    return ratio(kept - expense, kept, 4)


def burn_rate(expense: Column, start: Column, end: Column) -> Column:
    """Average spend per hour, day, week and month of an inclusive range; NULL if it is open."""
    days = F.greatest(F.datediff(end, start) + 1, F.lit(1)).cast("double")
    per_day = expense.cast("double") / days
    rates = F.struct(
        (per_day / F.lit(24.0)).alias("per_hour"),
        per_day.alias("per_day"),
        (per_day * F.lit(7.0)).alias("per_week"),
        (per_day * F.lit(DAYS_PER_MONTH)).alias("per_month"),
    )
    return F.when(start.isNotNull() & end.isNotNull(), rates)


def statutory_split(category_totals: DataFrame, categories: DataFrame) -> DataFrame:
    """Expense per user, split by the statutory flag of the category."""
    expenses = category_totals.filter(F.col("direction") == OUTBOUND)
    return (
        with_category(expenses, categories, statutory="statutory")
        .groupBy("user_id", F.coalesce("statutory", F.lit(False)).alias("statutory"))
        .agg(money_sum(F.col("total")).alias("total"))
    )
