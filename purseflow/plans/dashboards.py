"""Reports with one row per user: overview and dashboard summary.

The transactions are read and shuffled once: they are added up per (user, category), and those
few rows per user give the totals, the category list, the top categories and the findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from purseflow.functions.money import inbound, money, money_sum, outbound
from purseflow.operators.fx import convert, to_display
from purseflow.operators.insights import insight_list
from purseflow.operators.ledger import filter_transactions, with_category_name
from purseflow.operators.payroll import active_salary, stored_salary_figures
from purseflow.operators.reports import TOP_CATEGORIES, savings_rate
from purseflow.schemas import INBOUND, OUTBOUND, TOTAL


def user_rollup(converted: DataFrame, categories: DataFrame) -> DataFrame:
    """Income, expense and the nested category totals of each user with transactions."""
    by_category = converted.groupBy("user_id", "category_id").agg(
        money_sum(inbound(F.col("amt"))).alias("_income"),
        money_sum(outbound(F.col("amt"))).alias("_expense"),
        F.min_by(F.col("direction") == INBOUND, "id").alias("_inbound"),
    )
    entry = F.struct(
        "category_id",
        "category_name",
        F.when(F.col("_inbound"), INBOUND).otherwise(OUTBOUND).alias("direction"),
        money(F.col("_income") + F.col("_expense")).alias("total"),
    )
    return (
        with_category_name(by_category, categories)
        .groupBy("user_id")
        .agg(
            money_sum(F.col("_income")).alias("total_income"),
            money_sum(F.col("_expense")).alias("total_expense"),
            F.array_sort(F.collect_list(entry)).alias("categories"),
        )
    )


def top_of_list(categories: Column, k: int = TOP_CATEGORIES) -> Column:
    """The k largest expense entries of a nested category list, largest first."""
    expenses = F.filter(categories, lambda c: c["direction"] == OUTBOUND)
    fields = ("category_id", "category_name", "direction", "total")
    ordered = F.array_sort(
        F.transform(
            expenses,
            lambda c: F.struct((-c["total"]).alias("_order"), *[c[f].alias(f) for f in fields]),
        )
    )
    return F.transform(
        F.slice(ordered, 1, k), lambda c: F.struct(*[c[f].alias(f) for f in fields])
    )


def user_summary(
    users: DataFrame,
    converted: DataFrame,
    categories: DataFrame,
    profiles: DataFrame,
    matrix: DataFrame,
    currency: str | None = None,
    chosen: bool = False,
) -> DataFrame:
    """One row per user, also for users without transactions or salary.

    ``profiles`` carry their stored breakdown; the active one gives the reference income. With
    ``chosen`` they are the active ones already, one per user. ``converted`` are transactions, or a
    rollup of them (``operators.rollup``).
    """
    code = F.upper("base_currency") if currency is None else F.lit(currency.upper())
    zero = F.lit(0).cast(TOTAL)
    salaries = profiles if chosen else active_salary(profiles)
    people = (
        users.select(F.col("id").alias("user_id"), code.alias("currency"))
        .join(user_rollup(converted, categories), "user_id", "left")
        .join(stored_salary_figures(salaries), "user_id", "left")
        .withColumn("total_income", F.coalesce("total_income", zero))
        .withColumn("total_expense", F.coalesce("total_expense", zero))
    )
    priced = convert(
        people, matrix, "net_period", "salary_currency", F.col("currency"), "salary_net"
    )
    # A salary of exactly 0 counts as none for the savings rate.
    has_salary = F.col("salary_net").isNotNull() & (F.col("salary_net") != 0)
    reference = F.when(has_salary, F.col("salary_net")).otherwise(F.col("total_income"))
    return priced.select(
        "user_id",
        "currency",
        "total_income",
        "total_expense",
        money(F.col("total_income") - F.col("total_expense")).alias("net_cashflow"),
        "salary_net",
        "deduction_rate",
        savings_rate(reference, F.col("total_expense")).alias("savings_rate"),
        F.coalesce("categories", _no_categories(priced)).alias("categories"),
    )


def _no_categories(df: DataFrame) -> Column:
    return F.array().cast(df.schema["categories"].dataType)


def overview(
    users: DataFrame,
    tx: DataFrame,
    categories: DataFrame,
    profiles: DataFrame,
    matrix: DataFrame,
    currency: str | None = None,
    chosen: bool = False,
    **filters,
) -> DataFrame:
    """Totals, salary, savings rate and the nested category list of every user."""
    rows = filter_transactions(tx, **filters)
    converted = to_display(rows, matrix, currency, users)
    return user_summary(users, converted, categories, profiles, matrix, currency, chosen)


def insight_summary(summary: DataFrame) -> DataFrame:
    """The summary with what the findings need, read off the nested category list."""
    top = F.try_element_at(top_of_list(F.col("categories"), 1), F.lit(1))
    earning = F.filter(
        "categories", lambda c: (c["direction"] == INBOUND) & (c["total"] > 0)
    )
    return (
        summary.withColumn("_top", top)
        .withColumn("income_streams", F.coalesce(F.size(earning), F.lit(0)))
        .withColumn("top_name", F.col("_top.category_name"))
        .withColumn("top_total", F.col("_top.total"))
        .drop("_top")
    )


def dashboard(
    users: DataFrame,
    tx: DataFrame,
    categories: DataFrame,
    profiles: DataFrame,
    matrix: DataFrame,
    currency: str | None = None,
    chosen: bool = False,
    **filters,
) -> DataFrame:
    """Totals, salary, savings rate, top expense categories and findings of every user."""
    base = overview(users, tx, categories, profiles, matrix, currency, chosen, **filters)
    found = insight_list(insight_summary(base))
    return found.withColumn("top_expense_categories", top_of_list(F.col("categories"))).drop(
        "categories", "deduction_rate", "top_name", "top_total", "income_streams"
    )
