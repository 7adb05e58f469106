from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import BUDGETS, dec, transactions
from purseflow.operators import budgets as b, fx, ledger

ANCHOR = date(2026, 6, 15)
OVERRIDES = "user_id bigint, scope string, period_start date, amount decimal(14,2), currency string"


def status(demo_budgets, demo, categories, matrix, scope, anchor=ANCHOR):
    return b.budget_status(demo_budgets, demo, categories, matrix, scope, anchor)


def test_status_by_scope(demo_budgets, demo, categories, matrix):
    expected = {"month": (500, 480), "3m": (1460, 890), "ytd": (1460, 890), "all": (1460, 890)}
    for scope, (limit, spent) in expected.items():
        (row,) = status(demo_budgets, demo, categories, matrix, scope).collect()
        assert (row.category_name, row.limit_amount, row.spent) == ("Groceries", limit, spent)
        assert row.year == (2026 if scope == "month" else None) and row.scope == scope
    (row,) = status(demo_budgets, demo, categories, matrix, "month").collect()
    assert (row.remaining, row.utilization, row.over_budget) == (20, dec("0.9600"), False)
    assert (row.period_start, row.period_end) == (date(2026, 6, 1), date(2026, 6, 30))


def test_year_and_month_mean_that_month(demo_budgets, demo, categories, matrix):
    plain = b.budget_status(demo_budgets, demo, categories, matrix, year=2026, month=5)
    assert plain.first().limit_amount == 480 and plain.first().scope == "month"
    with pytest.raises(ValueError):
        b.budget_status(demo_budgets, demo, categories, matrix)
    assert status(demo_budgets, demo, categories, matrix, "month", date(2020, 1, 1)).count() == 0


def test_limits_convert_to_the_latest_currency(spark, demo, categories, matrix):
    rows = [(1, 5, 2026, 5, dec(5800), "PHP"), (1, 5, 2026, 6, dec(100), "USD")]
    mixed = spark.createDataFrame(rows, BUDGETS)
    (row,) = status(mixed, demo, categories, matrix, "3m").collect()
    assert (row.currency, row.limit_amount, row.spent) == ("USD", 200, 370)
    assert row.over_budget


def test_all_scope_spends_over_the_whole_span(spark, categories, matrix):
    rows = [(1, 4, 2026, 1, dec(100), "USD"), (1, 4, 2026, 6, dec(100), "USD")]
    gap = transactions(spark, [(1, 1, 4, 30, date(2026, 3, 3), None), (2, 1, 4, 9, date(2026, 7, 1), None)])
    (row,) = status(spark.createDataFrame(rows, BUDGETS), gap, categories, matrix, "all").collect()
    assert (row.limit_amount, row.spent) == (200, 30)


def test_kpis_and_projection(spark, demo, categories, matrix):
    rows = [
        (1, 4, 2026, 6, dec(500), "USD"),  # 480 spent: at risk
        (1, 5, 2026, 6, dec(200), "USD"),  # 220 spent: over
        (1, 6, 2026, 6, dec(400), "USD"),  # 160 spent: on track
    ]
    found = status(spark.createDataFrame(rows, BUDGETS), demo, categories, matrix, "month")
    kpi = b.budget_kpis(found).first()
    assert (kpi.on_track, kpi.at_risk, kpi.over_count, kpi.over_amount) == (1, 1, 1, 20)
    line = b.budget_projection(found, ANCHOR).first()
    assert (line.elapsed_days, line.total_days, line.projected) == (15, 30, 1720.0)
    assert line.flagged
    late = b.budget_projection(found, date(2026, 9, 1)).first()
    assert late.elapsed_days == 30 and late.projected == 860.0


def fund(spark, users, demo_budgets, demo, matrix, overrides, scopes):
    table = spark.createDataFrame(overrides, OVERRIDES)
    converted = fx.to_display(demo, matrix, "USD")
    out = b.fund_status(users, demo_budgets, table, converted, scopes, ANCHOR, "USD")
    return {r.scope: r for r in out.filter("user_id = 1").collect()}


def test_opening_fund(spark, users, demo_budgets, demo, matrix):
    scopes = ["month", "3m", "ytd", "all"]
    plain = fund(spark, users, demo_budgets, demo, matrix, [], scopes)
    assert {s: r.amount for s, r in plain.items()} == {"month": 2530, "3m": 0, "ytd": 0, "all": 0}
    assert plain["all"].period_start == date(1970, 1, 1)
    assert plain["all"].period_end == date(2026, 6, 30)
    given = [(1, "month", date(2026, 6, 1), dec(1000), "PHP"), (1, "ytd", date(2025, 1, 1), dec(1), "USD")]
    own = fund(spark, users, demo_budgets, demo, matrix, given, scopes)
    assert (own["month"].amount, own["month"].currency, own["month"].is_override) == (1000, "PHP", True)
    assert not own["ytd"].is_override


def test_balance_with_fund(spark, users, demo_budgets, demo, matrix):
    converted = fx.to_display(demo, matrix, "USD")
    none = spark.createDataFrame([], OVERRIDES)
    funds = b.fund_status(users, demo_budgets, none, converted, ["month"], ANCHOR, "USD")
    days = b.balance_with_fund(converted, funds, "month", ANCHOR).orderBy("occurred_on").collect()
    assert days[0].balance_with_fund == dec("4590.00") + 2530
    assert days[-1].balance_with_fund == dec("5125.00")


def test_budget_checks(spark, categories):
    rows = [
        (1, 4, 2026, 6, dec(5), "USD"),
        (2, 1, 2026, 6, dec(5), "USD"),
        (3, 99, 2026, 6, dec(5), "USD"),
        (4, 4, 2026, 13, dec(5), "USD"),
        (5, 4, 2026, 6, dec(0), "USD"),
    ]
    found = ledger.budget_rejects(spark.createDataFrame(rows, BUDGETS), categories)
    assert {r.user_id: r.reason for r in found.collect()} == {
        2: "not an expense category",
        3: "not an expense category",
        4: "month out of range",
        5: "limit must be positive",
    }


def test_spend_of_a_hot_category(spark, categories, matrix):
    """Nearly all rows in one (user, category): the salted join loses and doubles nothing."""
    rows = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 50 == 0, 2).otherwise(1).cast("bigint").alias("user_id"),
        F.lit("outbound").alias("direction"),
        F.lit(4).alias("category_id"),
        F.lit(dec("0.10")).cast("decimal(14,2)").alias("amount"),
        F.lit("PHP").alias("currency"),
        F.lit(date(2026, 6, 3)).alias("occurred_on"),
    )
    limits = [(1, 4, 2026, 6, dec(500), "PHP"), (2, 4, 2026, 6, dec(500), "USD")]
    found = status(spark.createDataFrame(limits, BUDGETS), rows, categories, matrix, "month")
    spent = {r.user_id: r.spent for r in found.collect()}
    assert spent == {1: dec("294.00"), 2: dec("0.00")}  # 10 centavos round to 0 cents each
