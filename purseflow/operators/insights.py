"""Rule-based findings per user, from totals, category totals and salary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from purseflow.functions.money import percent_text, ratio

# Thresholds and texts of the findings.
SAVINGS_TARGET = "0.20"
CONCENTRATED_SHARE = "0.40"
DIVERSIFIED_SHARE = "0.25"
TITLES = {
    "overspend": "Spending exceeds income",
    "low_savings": "Savings rate below 20%",
    "healthy_savings": "Healthy savings rate",
    "concentrated_spend": " dominates spending",
    "diversified_spend": "Spending is well spread out",
    "multiple_income_streams": "Multiple slices of income",
    "no_expenses_yet": "Nothing spent yet",
    "no_signal": "Not enough data yet",
}
DETAILS = {
    "overspend": ("Expenses (", ") are above your reference income (", ") for this period."),
    "low_savings": ("Saving ", " of income. A common target is 20%+."),
    "healthy_savings": ("Saving ", " of your reference income this period."),
    "concentrated_spend": " of expenses went to ",
    "diversified_spend": (
        "No single category ate more than a quarter of your outgoings — "
        "a balanced loaf, not a lopsided one."
    ),
    "multiple_income_streams": (
        "You're not living off one loaf — ",
        " income streams contributed this period.",
    ),
    "no_expenses_yet": "No debits recorded this period — the crust is still intact.",
    "no_signal": "Add salary and a few transactions to unlock personalized insights.",
}


def _finding(condition: Column, key: str, severity: str, title: Column, detail: Column) -> Column:
    return F.when(
        condition,
        F.struct(
            F.lit(key).alias("key"),
            F.lit(severity).alias("severity"),
            title.alias("title"),
            detail.alias("detail"),
        ),
    )


def _share(text: str) -> Column:
    return F.lit(text).cast("decimal(20,2)")


def _findings() -> list[Column]:
    """The rules in order; each is NULL where it does not apply."""
    zero = F.lit(0).cast("decimal(18,2)")
    income, expense = F.col("total_income"), F.col("total_expense")
    reference, rate, share = F.col("_reference"), F.col("_rate"), F.col("_share")
    measured, spent = reference > 0, F.col("top_total").isNotNull() & (expense > 0)
    currency = F.concat(F.lit(" "), F.col("currency"))
    # A tiny overspend that rounds to zero is shown as -0%, its sign kept.
    saved = F.when((rate == 0) & (reference < expense), F.lit("-0%")).otherwise(percent_text(rate))

    def fixed(key: str) -> Column:
        return F.lit(TITLES[key])

    over, low, good = (DETAILS[k] for k in ("overspend", "low_savings", "healthy_savings"))
    streams = DETAILS["multiple_income_streams"]
    return [
        _finding(
            measured & (rate < 0),
            "overspend",
            "warning",
            fixed("overspend"),
            F.concat(
                F.lit(over[0]),
                expense.cast("string"),
                currency,
                F.lit(over[1]),
                reference.cast("string"),
                currency,
                F.lit(over[2]),
            ),
        ),
        _finding(
            measured & (rate >= 0) & (rate < _share(SAVINGS_TARGET)),
            "low_savings",
            "warning",
            fixed("low_savings"),
            F.concat(F.lit(low[0]), saved, F.lit(low[1])),
        ),
        _finding(
            measured & (rate >= _share(SAVINGS_TARGET)),
            "healthy_savings",
            "good",
            fixed("healthy_savings"),
            F.concat(F.lit(good[0]), saved, F.lit(good[1])),
        ),
        _finding(
            spent & (share >= _share(CONCENTRATED_SHARE)),
            "concentrated_spend",
            "info",
            F.concat(F.col("top_name"), fixed("concentrated_spend")),
            F.concat(
                percent_text(share),
                F.lit(DETAILS["concentrated_spend"]),
                F.col("top_name"),
                F.lit(" ("),
                F.col("top_total").cast("string"),
                currency,
                F.lit(")."),
            ),
        ),
        _finding(
            spent & (share < _share(DIVERSIFIED_SHARE)),
            "diversified_spend",
            "good",
            fixed("diversified_spend"),
            F.lit(DETAILS["diversified_spend"]),
        ),
        _finding(
            F.col("income_streams") > 1,
            "multiple_income_streams",
            "info",
            fixed("multiple_income_streams"),
            F.concat(F.lit(streams[0]), F.col("income_streams").cast("string"), F.lit(streams[1])),
        ),
        _finding(
            (expense == zero) & (income > zero),
            "no_expenses_yet",
            "info",
            fixed("no_expenses_yet"),
            F.lit(DETAILS["no_expenses_yet"]),
        ),
    ]


def insight_list(summary: DataFrame) -> DataFrame:
    """Add ``insights`` to one row per user that holds currency, totals, salary_net, top_name,
    top_total and income_streams."""
    expense, salary, reference = F.col("total_expense"), F.col("salary_net"), F.col("_reference")
    measured = summary.withColumn(
        "_reference", F.when(salary > 0, salary).otherwise(F.col("total_income"))
    ).withColumns(
        {
            "_rate": ratio(reference - expense, reference, 2),
            "_share": ratio(F.col("top_total"), expense, 2),
        }
    )
    found = F.array_compact(F.array(*_findings()))
    nothing = F.array(
        _finding(
            F.lit(True),
            "no_signal",
            "info",
            F.lit(TITLES["no_signal"]),
            F.lit(DETAILS["no_signal"]),
        )
    )
    with_found = measured.withColumn("_found", found)
    listed = F.when(F.size("_found") > 0, F.col("_found")).otherwise(nothing)
    return with_found.withColumn("insights", listed).drop(
        "_found", "_reference", "_rate", "_share"
    )


def insights(summary: DataFrame) -> DataFrame:
    """One row per finding."""
    # Outer for the planner's sake: the list is never empty.
    return insight_list(summary).select(
        "user_id", F.posexplode_outer("insights").alias("position", "insight")
    ).select("user_id", (F.col("position") + 1).alias("position"), "insight.*")
