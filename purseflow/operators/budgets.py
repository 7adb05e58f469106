"""Budgets over a period: limits, spend, status, opening fund, key figures and projection."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from purseflow.functions.money import money, money_sum, ratio, signed
from purseflow.functions.periods import (
    as_day,
    fund_period_start,
    month_of,
    period_end,
    period_start,
    previous_period_end,
)
from purseflow.operators.fx import convert
from purseflow.operators.ledger import filter_transactions, with_category_name
from purseflow.operators.reports import running_balance
from purseflow.operators.skew import lookup_join
from purseflow.schemas import OUTBOUND, SCOPES
from purseflow.session import staged

KEY = ["user_id", "category_id"]
UNKNOWN = "Unknown"
AT_RISK = "0.8"


def _check_scope(scope: str) -> None:
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {SCOPES}")


def budget_months(budgets: DataFrame) -> DataFrame:
    """Distinct budgeted months of each user."""
    return budgets.select("user_id", "year", "month").distinct()


def budget_span(budgets: DataFrame) -> DataFrame:
    """First day, exclusive end and count of the budgeted months of each user."""
    first = month_of(F.col("year"), F.col("month"))
    months = budget_months(budgets).withColumn("_month", first)
    return months.groupBy("user_id").agg(
        F.min("_month").alias("period_start"),
        F.add_months(F.max("_month"), 1).alias("period_end"),
        F.count(F.lit(1)).cast("int").alias("month_count"),
    )


def period_bounds(
    users: DataFrame, budgets: DataFrame, scope: str, anchor: Column | date
) -> DataFrame:
    """Each user's period: start, exclusive end and number of covered months."""
    _check_scope(scope)
    people = users.select(F.col("id").alias("user_id"))
    day = as_day(anchor)
    if scope != "all":
        start, end = period_start(scope, day), period_end(scope, day)
        count = F.months_between(end, start).cast("int")
        return people.select(
            "user_id",
            start.alias("period_start"),
            end.alias("period_end"),
            count.alias("month_count"),
        )
    spans = people.join(budget_span(budgets), "user_id", "left")
    return spans.select(
        "user_id",
        F.coalesce("period_start", F.trunc(day, "month")).alias("period_start"),
        F.coalesce("period_end", F.add_months(F.trunc(day, "month"), 1)).alias("period_end"),
        F.coalesce("month_count", F.lit(0)).alias("month_count"),
    )


def _in_scope(budgets: DataFrame, scope: str, anchor: Column | date) -> DataFrame:
    """Budget rows of the period, with the period on each row."""
    _check_scope(scope)
    if scope == "all":
        return budgets.join(budget_span(budgets).drop("month_count"), "user_id")
    start, end = period_start(scope, anchor), period_end(scope, anchor)
    month = month_of(F.col("year"), F.col("month"))
    # The year bound reaches the scan; the month bound is exact.
    years = F.col("year").between(F.year(start), F.year(as_day(anchor)))
    return (
        budgets.filter(years & (month >= start) & (month < end))
        .withColumn("period_start", start)
        .withColumn("period_end", end)
    )


def budget_limits(
    budgets: DataFrame, matrix: DataFrame, scope: str, anchor: Column | date
) -> DataFrame:
    """Limit per (user, category): monthly limits in the currency of the latest month.

    Staged: spend and status both read it, and its size decides how spend joins it.
    """
    months = Window.partitionBy(*KEY)
    newest = F.max_by("currency", F.struct("year", "month")).over(months)
    rows = _in_scope(budgets, scope, anchor).withColumn("target_currency", newest)
    limits = convert(rows, matrix, "limit_amount", "currency", F.col("target_currency"), "_limit")
    per_pair = limits.groupBy(*KEY).agg(
        money_sum(F.col("_limit")).alias("limit_amount"),
        F.first("target_currency").alias("currency"),
        F.first("period_start").alias("period_start"),
        F.first("period_end").alias("period_end"),
    )
    return staged(per_pair, "limits")


def budget_spend(
    limits: DataFrame,
    tx: DataFrame,
    matrix: DataFrame,
    scope: str = "all",
    anchor: Column | date | None = None,
) -> DataFrame:
    """Spend per budgeted (user, category) in the budget's currency over the period.

    Expenses meet the limit of their user and category, and are converted and rounded once, per
    row. Periods are whole months.
    """
    dated = scope != "all"
    expenses = filter_transactions(
        tx,
        start=period_start(scope, anchor) if dated else None,
        end=F.date_sub(period_end(scope, anchor), 1) if dated else None,
        direction=OUTBOUND,
    )
    targets = limits.select(
        *KEY, F.col("currency").alias("target_currency"), "period_start", "period_end"
    )
    day = F.col("occurred_on")
    matched = lookup_join(
        expenses.select(*KEY, "amount", "currency", "occurred_on"), targets, KEY, "inner", counted=limits
    ).filter((day >= F.col("period_start")) & (day < F.col("period_end")))
    spent = convert(matched, matrix, "amount", "currency", F.col("target_currency"))
    return spent.groupBy(*KEY).agg(money_sum(F.col("amt")).alias("spent"))


def budget_status(
    budgets: DataFrame,
    tx: DataFrame,
    categories: DataFrame,
    matrix: DataFrame,
    scope: str | None = None,
    anchor: Column | date | None = None,
    year: int | None = None,
    month: int | None = None,
) -> DataFrame:
    """Limit against spend for every budgeted category; a bare year and month mean that month."""
    if scope is None:
        if year is None or month is None:
            raise ValueError("give a scope and anchor, or a year and month")
        scope, anchor = "month", date(year, month, 1)
    limits = budget_limits(budgets, matrix, scope, anchor)
    spend = budget_spend(limits, tx, matrix, scope, anchor)
    spent = F.coalesce("spent", F.lit(0)).cast("decimal(18,2)")
    joined = limits.join(spend, KEY, "left").withColumn("spent", spent)
    day = as_day(anchor)
    single = scope == "month"
    rows = joined.select(
        *KEY,
        (F.year(day) if single else F.lit(None).cast("int")).alias("year"),
        (F.month(day) if single else F.lit(None).cast("int")).alias("month"),
        F.lit(scope).alias("scope"),
        "period_start",
        F.date_sub("period_end", 1).alias("period_end"),
        "limit_amount",
        "spent",
        money(F.col("limit_amount") - F.col("spent")).alias("remaining"),
        ratio(F.col("spent"), F.col("limit_amount"), 4).alias("utilization"),
        "currency",
        (F.col("spent") > F.col("limit_amount")).alias("over_budget"),
    )
    return with_category_name(rows, categories, UNKNOWN)


def budget_kpis(status: DataFrame, by: Sequence[str] = ("user_id", "currency")) -> DataFrame:
    """Counts of on-track, at-risk and over-budget rows, per user and currency.

    A status of several scopes or requests takes their columns into ``by``.
    """
    over = F.col("over_budget")
    near = F.col("utilization") >= F.lit(AT_RISK).cast("decimal(20,4)")
    return status.groupBy(*by).agg(
        F.count_if(~over & ~near).alias("on_track"),
        F.count_if(~over & near).alias("at_risk"),
        F.count_if(over).alias("over_count"),
        money_sum(F.when(over, F.col("spent") - F.col("limit_amount"))).alias("over_amount"),
    )


def budget_projection(
    status: DataFrame, today: Column | date, by: Sequence[str] = ("user_id", "currency")
) -> DataFrame:
    """Spend projected to the period's end at the pace so far; nothing for the all-time scope.

    A status of several scopes or requests takes their columns into ``by``.
    """
    day = as_day(today)
    length = (F.datediff("period_end", "period_start") + 1).alias("total_days")
    passed = F.datediff(day, F.col("period_start")) + 1
    sums = (
        status.filter(F.col("scope") != "all")
        .groupBy(*by, "period_start", "period_end")
        .agg(
            money_sum(F.col("spent")).alias("spent"),
            money_sum(F.col("limit_amount")).alias("limit_amount"),
        )
        .withColumn("total_days", length)
        .withColumn("elapsed_days", F.least(F.greatest(passed, F.lit(1)), F.col("total_days")))
    )
    pace = F.col("spent").cast("double") / F.col("elapsed_days").cast("double")
    return sums.withColumn("projected", pace * F.col("total_days").cast("double")).withColumn(
        "flagged", F.col("projected") > F.col("limit_amount").cast("double")
    )


def carry_over_funds(
    users: DataFrame, converted: DataFrame, scopes: Sequence[str], anchor: Column | date
) -> DataFrame:
    """Default opening fund per user and scope: the balance on the day before the period.

    All scopes are answered by one pass over the transactions; the all-time scope opens at 0.
    ``converted`` is in one currency per user.
    """
    for scope in scopes:
        _check_scope(scope)
    dated = [scope for scope in scopes if scope != "all"]
    flow = signed(F.col("amt"))
    people = users.select(F.col("id").alias("user_id"))
    zero = F.lit(0).cast("decimal(18,2)")
    if dated:
        ends = {scope: previous_period_end(scope, anchor) for scope in dated}
        last = F.greatest(*ends.values()) if len(dated) > 1 else ends[dated[0]]
        sums = [
            money_sum(F.when(F.col("occurred_on") <= end, flow)).alias(f"_{scope}")
            for scope, end in ends.items()
        ]
        held = filter_transactions(converted, end=last).groupBy("user_id").agg(*sums)
        people = people.join(held, "user_id", "left")
    amounts = [
        F.struct(
            F.lit(scope).alias("scope"),
            (zero if scope == "all" else F.coalesce(f"_{scope}", zero)).alias("amount"),
        )
        for scope in scopes
    ]
    return people.select("user_id", F.inline(F.array(*amounts)))


def fund_status(
    users: DataFrame,
    budgets: DataFrame,
    overrides: DataFrame,
    converted: DataFrame,
    scopes: Sequence[str],
    anchor: Column | date,
    currency: str | None = None,
) -> DataFrame:
    """Opening fund per user and scope: the user's override in its own currency, else the
    carry-over in the display currency."""
    shown = F.upper("base_currency") if currency is None else F.lit(currency.upper())
    people = users.select(F.col("id").alias("user_id"), shown.alias("_shown"))
    if "all" in scopes:
        span = budget_span(budgets).select("user_id", F.col("period_end").alias("_span_end"))
        people = people.join(span, "user_id", "left")
    else:
        people = people.withColumn("_span_end", F.lit(None).cast("date"))
    chosen = overrides.select(
        "user_id",
        "scope",
        F.col("period_start").alias("fund_start"),
        F.col("amount").cast("decimal(18,2)").alias("_amount"),
        F.col("currency").alias("_currency"),
    )
    scope = F.col("scope")
    month_end = F.add_months(F.trunc(as_day(anchor), "month"), 1)
    end = F.when(scope == "all", F.coalesce("_span_end", month_end)).otherwise(month_end)
    return (
        carry_over_funds(users, converted, scopes, anchor)
        .join(people, "user_id")
        .withColumn("fund_start", fund_period_start(scope, anchor))
        .join(chosen, ["user_id", "scope", "fund_start"], "left")
        .select(
            "user_id",
            "scope",
            F.col("fund_start").alias("period_start"),
            F.date_sub(end, 1).alias("period_end"),
            F.coalesce("_amount", "amount").alias("amount"),
            F.coalesce("_currency", "_shown").alias("currency"),
            F.col("_amount").isNotNull().alias("is_override"),
        )
    )


def balance_with_fund(
    converted: DataFrame, funds: DataFrame, scope: str, anchor: Column | date
) -> DataFrame:
    """Daily balance over the period, lifted by the opening fund."""
    last = None if scope == "all" else F.date_sub(period_end(scope, anchor), 1)
    first = None if scope == "all" else period_start(scope, anchor)
    days = running_balance(converted, first, last)
    opened = days.join(funds.select("user_id", F.col("amount").alias("fund")), "user_id", "left")
    fund = F.coalesce("fund", F.lit(0)).cast("decimal(18,2)")
    return opened.withColumn("balance_with_fund", money(F.col("balance") + fund))
