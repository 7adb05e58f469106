"""Budgets, spend and funds for a table of requests, each with a user, scope and anchor day.

One job answers all of them: budgets are read once, transactions once, and each row is converted
once per currency that its budgets ask for. A period depends on the scope and the anchor's month
only, so a user has at most four periods per calendar month; they ride along in an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from purseflow.functions.money import money, money_sum, ratio
from purseflow.functions.periods import fund_period_start, month_of, period_end, period_start
from purseflow.operators.budgets import KEY, UNKNOWN, budget_span
from purseflow.operators.fx import convert
from purseflow.operators.ledger import filter_transactions, with_category_name
from purseflow.operators.reports import daily_totals
from purseflow.operators.skew import is_small, lookup_join
from purseflow.schemas import MONTH_COLUMN, OUTBOUND, SCOPES
from purseflow.session import staged

REQUEST = ["user_id", "scope", "anchor"]
PERIOD = ["user_id", "scope", "anchor_month"]


def checked_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distinct valid requests, invalid ones with a ``reason``)."""
    asked = requests.select("user_id", "scope", F.col("anchor").cast("date").alias("anchor"))
    known = F.coalesce(F.col("scope").isin(list(SCOPES)), F.lit(False))
    reason = F.when(~known, "unknown scope").when(F.col("anchor").isNull(), "no anchor").when(
        F.col("user_id").isNull(), "no user"
    )
    judged = asked.distinct().withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def asked_budgets(requests: DataFrame, budgets: DataFrame) -> DataFrame:
    """Budgets of users that ask, staged; nothing else reads the stored budgets."""
    people = requests.select("user_id").distinct()
    return staged(budgets.join(people, "user_id", "left_semi"), "asked-budgets")


def asked_periods(requests: DataFrame, budgets: DataFrame) -> DataFrame:
    """Distinct (user_id, scope, anchor_month) with period_start, exclusive period_end and
    month_count; the all-time scope covers the user's budgeted months, or else the anchor's."""
    asked = requests.select(
        "user_id", "scope", F.trunc("anchor", "month").alias("anchor_month")
    ).distinct()
    scope, month = F.col("scope"), F.col("anchor_month")
    start, end = period_start(scope, month), period_end(scope, month)
    spans = budget_span(budgets).select(
        "user_id", *[F.col(c).alias(f"_{c}") for c in ("period_start", "period_end", "month_count")]
    )
    dated = scope != "all"
    return asked.join(spans, "user_id", "left").select(
        *PERIOD,
        F.when(dated, start).otherwise(F.coalesce("_period_start", month)).alias("period_start"),
        F.when(dated, end)
        .otherwise(F.coalesce("_period_end", F.add_months(month, 1)))
        .alias("period_end"),
        F.when(dated, F.months_between(end, start).cast("int"))
        .otherwise(F.coalesce("_month_count", F.lit(0)))
        .alias("month_count"),
    )


def periods_by_user(periods: DataFrame) -> DataFrame:
    """One row per user with an array of periods, at most four per calendar month."""
    entry = F.struct("scope", "anchor_month", "period_start", "period_end")
    return periods.groupBy("user_id").agg(F.collect_set(entry).alias("_periods"))


def _within(rows: DataFrame, by_user: DataFrame, day: Column) -> DataFrame:
    """Rows once for each of their user's periods that a day of theirs lies in."""
    joined = lookup_join(rows.withColumn("_day", day), by_user, ["user_id"], "inner")
    mine = F.filter(
        "_periods", lambda p: (F.col("_day") >= p["period_start"]) & (F.col("_day") < p["period_end"])
    )
    return joined.withColumn("_period", F.explode(mine)).select(
        *rows.columns, "_period.scope", "_period.anchor_month", "_period.period_start", "_period.period_end"
    )


def in_asked_months(tx: DataFrame, periods: DataFrame) -> DataFrame:
    """Transactions of months that some period covers.

    The list of months is as long as the calendar at most; where the table is stored by month, its
    other folders are not opened.
    """
    last = F.add_months("period_end", -1)
    every = F.explode(F.sequence("period_start", last, F.expr("interval 1 month")))
    spans = periods.select("period_start", "period_end").distinct()
    months = [r[0] for r in spans.select(every.alias("m")).distinct().collect()]
    held = F.col(MONTH_COLUMN) if MONTH_COLUMN in tx.columns else F.trunc("occurred_on", "month")
    return tx.filter(held.isin(*months) if months else F.lit(False))


def limits_asked(periods: DataFrame, budgets: DataFrame, matrix: DataFrame) -> DataFrame:
    """Limit per period and category, in the currency of the period's latest budget; staged."""
    rows = budgets.select(*KEY, "year", "month", "limit_amount", "currency")
    first = month_of(F.col("year"), F.col("month"))
    covered = _within(rows, staged(periods_by_user(periods), "periods"), first)
    group = Window.partitionBy(*PERIOD, "category_id")
    newest = F.max_by("currency", F.struct("year", "month")).over(group)
    priced = convert(
        covered.withColumn("target", newest), matrix, "limit_amount", "currency", F.col("target"), "_limit"
    )
    limits = priced.groupBy(*PERIOD, "category_id").agg(
        money_sum(F.col("_limit")).alias("limit_amount"),
        F.first("target").alias("currency"),
        F.first("period_start").alias("period_start"),
        F.first("period_end").alias("period_end"),
    )
    return staged(limits, "asked-limits")


def spend_asked(limits: DataFrame, tx: DataFrame, matrix: DataFrame) -> DataFrame:
    """Spend per period and budgeted category, in the limit's currency.

    An expense is converted and rounded once per currency that limits of its user and category
    have, mostly one. Months are added up before the periods pick theirs.
    """
    asked = staged(
        limits.groupBy(*KEY).agg(
            F.collect_set("currency").alias("_currencies"),
            F.min("period_start").alias("_first"),
            F.max("period_end").alias("_last"),
        ),
        "asked-pairs",
    )
    held = in_asked_months(filter_transactions(tx, direction=OUTBOUND), limits)
    expenses = held.select(*KEY, "amount", "currency", "occurred_on")
    if not is_small(asked):
        # Then the join reads them three times: for its sketch, its frequent and its other keys.
        expenses = staged(expenses, "asked-expenses")
    day = F.col("occurred_on")
    rows = (
        lookup_join(expenses, asked, KEY, "inner")
        .filter((day >= F.col("_first")) & (day < F.col("_last")))
        .withColumn("target", F.explode("_currencies"))
    )
    months = (
        convert(rows, matrix, "amount", "currency", F.col("target"))
        .groupBy(*KEY, "target", F.trunc("occurred_on", "month").alias("_month"))
        .agg(money_sum(F.col("amt")).alias("_spent"))
    )
    wanted = limits.withColumnRenamed("currency", "target").drop("limit_amount")
    in_period = (F.col("_month") >= F.col("period_start")) & (F.col("_month") < F.col("period_end"))
    return (
        wanted.join(months, [*KEY, "target"])
        .filter(in_period)
        .groupBy(*PERIOD, "category_id")
        .agg(money_sum(F.col("_spent")).alias("spent"))
    )


def budget_status_asked(
    requests: DataFrame, budgets: DataFrame, tx: DataFrame, categories: DataFrame, matrix: DataFrame
) -> DataFrame:
    """Limit against spend for every budgeted category of every request.

    For a request's user the rows equal those of ``budgets.budget_status`` for its scope and anchor.
    """
    held = asked_budgets(requests, budgets)
    limits = limits_asked(asked_periods(requests, held), held, matrix)
    spend = spend_asked(limits, tx, matrix)
    joined = limits.join(spend, [*PERIOD, "category_id"], "left").withColumn(
        "spent", F.coalesce("spent", F.lit(0)).cast("decimal(18,2)")
    )
    asked = requests.withColumn("anchor_month", F.trunc("anchor", "month"))
    single = F.col("scope") == "month"
    rows = asked.join(joined, PERIOD).select(
        *KEY,
        "anchor",
        F.when(single, F.year("anchor")).alias("year"),
        F.when(single, F.month("anchor")).alias("month"),
        "scope",
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


def carry_over_asked(requests: DataFrame, nets: DataFrame) -> DataFrame:
    """(user_id, scope, anchor, amount): the balance before each request's period.

    ``nets`` holds one row (user_id, month, net) per user and month, computed or maintained
    (``balances.month_nets``). The all-time scope opens at 0.
    """
    start = period_start(F.col("scope"), F.col("anchor"))
    asked = requests.withColumn("_start", start)
    earlier = (
        asked.filter("_start is not null")
        .join(nets.select("user_id", F.col("month").alias("_month"), "net"), "user_id")
        .filter("_month < _start")
        .groupBy(*REQUEST)
        .agg(money_sum(F.col("net")).alias("amount"))
    )
    zero = F.lit(0).cast("decimal(18,2)")
    return requests.join(earlier, REQUEST, "left").withColumn("amount", F.coalesce("amount", zero))


def fund_status_asked(
    requests: DataFrame,
    users: DataFrame,
    budgets: DataFrame,
    overrides: DataFrame,
    nets: DataFrame,
    currency: str | None = None,
) -> DataFrame:
    """Opening fund of every request whose user exists: the override, else what is carried over.

    ``nets`` are in the display currency, each user's own unless ``currency`` is given.
    """
    shown = F.upper("base_currency") if currency is None else F.lit(currency.upper())
    people = users.select(F.col("id").alias("user_id"), shown.alias("_shown"))
    chosen = overrides.select(
        "user_id",
        "scope",
        F.col("period_start").alias("fund_start"),
        F.col("amount").cast("decimal(18,2)").alias("_amount"),
        F.col("currency").alias("_currency"),
    )
    span = budget_span(asked_budgets(requests.filter("scope = 'all'"), budgets)).select(
        "user_id", F.col("period_end").alias("_span_end")
    )
    scope, anchor = F.col("scope"), F.col("anchor")
    month_end = F.add_months(F.trunc(anchor, "month"), 1)
    end = F.when(scope == "all", F.coalesce("_span_end", month_end)).otherwise(month_end)
    return (
        carry_over_asked(requests, nets)
        .join(people, "user_id")
        .join(span, "user_id", "left")
        .withColumn("fund_start", fund_period_start(scope, anchor))
        .join(chosen, ["user_id", "scope", "fund_start"], "left")
        .select(
            *REQUEST,
            F.col("fund_start").alias("period_start"),
            F.date_sub(end, 1).alias("period_end"),
            F.coalesce("_amount", "amount").alias("amount"),
            F.coalesce("_currency", "_shown").alias("currency"),
            F.col("_amount").isNotNull().alias("is_override"),
        )
    )


def balance_with_fund_asked(requests: DataFrame, converted: DataFrame, funds: DataFrame) -> DataFrame:
    """Daily balance over each request's period, lifted by its opening fund.

    The all-time scope has no bounds, as in ``budgets.balance_with_fund``. Days are added up
    before they meet the periods, so a window holds at most a user's days.
    """
    month = F.trunc("anchor", "month")
    scope = F.col("scope")
    periods = requests.select(
        "user_id",
        "scope",
        month.alias("anchor_month"),
        F.coalesce(period_start(scope, month), F.lit("0001-01-01").cast("date")).alias("period_start"),
        F.coalesce(period_end(scope, month), F.lit("9999-12-31").cast("date")).alias("period_end"),
    ).distinct()
    by_user = staged(periods_by_user(periods), "periods")
    days = _within(daily_totals(converted), by_user, F.col("occurred_on"))
    line = (
        Window.partitionBy(*PERIOD)
        .orderBy("occurred_on")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = days.withColumn("balance", F.sum("net").over(line).cast("decimal(18,2)"))
    asked = requests.withColumn("anchor_month", month)
    fund = funds.select(*REQUEST, F.col("amount").alias("fund"))
    return (
        asked.join(running, PERIOD)
        .join(fund, REQUEST, "left")
        .withColumn("fund", F.coalesce("fund", F.lit(0)).cast("decimal(18,2)"))
        .withColumn("balance_with_fund", money(F.col("balance") + F.col("fund")))
        .drop("anchor_month", "period_start", "period_end")
    )
