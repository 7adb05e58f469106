from datetime import date

import pytest
from pyspark.sql import functions as F

from conftest import CATEGORIES, dec, transactions
from purseflow.functions import money as m
from purseflow.operators import fx, insights, reports as r, skew
from purseflow.plans import dashboards
from test_payroll import profiles
from purseflow.operators.payroll import profile_snapshot

ANCHOR = date(2026, 6, 15)


@pytest.fixture(scope="module")
def usd(demo, matrix):
    return fx.to_display(demo, matrix, "USD")


def test_rounding_rules(spark):
    values = spark.createDataFrame([(dec(x),) for x in ("0.125", "0.135", "-0.005")], "x decimal(10,3)")
    rows = values.select(m.money(F.col("x")), F.bround("x", 2), m.amount_text(F.col("x"))).collect()
    assert [r[0] for r in rows] == [dec("0.13"), dec("0.14"), dec("-0.01")]
    assert [r[1] for r in rows] == [dec("0.12"), dec("0.14"), dec("0.00")]
    assert [r[2] for r in rows][:2] == ["0.12", "0.14"]


def test_monthly_by_category(usd, categories):
    series = r.monthly_series(r.monthly_expense_by_category(usd, categories, 2))
    found = {x.category_name: [float(v) for v in x["values"]] for x in series.collect()}
    assert found["Housing"] == [1500, 1500] and found["Groceries"] == [410, 480]
    assert found["Dining"] == [150, 220] and found["Transport"] == [0, 160]
    assert "Base salary" not in found
    assert series.first().months == ["2026-05", "2026-06"]
    with pytest.raises(ValueError):
        r.monthly_expense_by_category(usd, categories, 0)


def test_months_without_data_are_not_counted(spark, matrix, categories):
    rows = [(1, 1, 4, 10, date(2025, 1, 5), None), (2, 1, 5, 20, date(2026, 6, 5), None)]
    converted = fx.to_display(transactions(spark, rows), matrix, "USD")
    grid = r.monthly_expense_by_category(converted, categories, 2)
    assert {(x.month, float(x.value)) for x in grid.collect()} == {
        ("2025-01", 10), ("2025-01", 0), ("2026-06", 20), ("2026-06", 0)
    }
    assert r.monthly_totals(converted, 1).first().month == "2026-06"


def test_top_plus_other_adds_up(usd, categories):
    grid = r.monthly_expense_by_category(usd, categories, 6)
    top = r.top_plus_other(grid, 2)
    assert top.agg(F.sum("value")).first() == grid.agg(F.sum("value")).first()
    assert {x.label for x in top.collect()} == {"Housing", "Groceries", "Other"}
    assert {x.label for x in r.top_plus_other(grid, 9).collect()}.isdisjoint({"Other"})


def test_unfolded_grid_is_dealt_by_rows(spark, matrix, categories, monkeypatch):
    # 180 pairs of a user's category and month are a few KB, which Spark would merge into one task.
    rows = [
        (i, i % 30, 4 + i % 2, 10, date(2026, 1 + i // 60, 5), None) for i in range(180)
    ]
    converted = fx.to_display(transactions(spark, rows), matrix, "USD")
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10, raising=False)
    top = r.top_plus_other(r.monthly_expense_by_category(converted, categories, 36), 1)
    assert top._jdf.queryExecution().toRdd().getNumPartitions() >= 9
    found = {(x.user_id, x.month, x.label != "Other"): x.value for x in top.collect()}
    assert len(found) == top.count() and sum(found.values()) == 1800


def test_balance_equals_cash_flow(usd):
    days = r.running_balance(usd).orderBy("occurred_on").collect()
    running = 0
    for day in days:
        running += day.net
        assert day.balance == running
    assert running == r.totals(usd).first().net_cashflow == dec("5125.00")
    assert r.balance_at(usd, date(2026, 5, 31)).first().balance == 2530


def test_totals_in_another_currency(demo, matrix):
    php = r.totals(fx.to_display(demo, matrix, "php")).first()
    assert php.total_income == dec("9780.00") * 58


def test_category_totals_and_top(usd, categories):
    totals = r.per_category_totals(usd, categories)
    assert totals.agg(F.sum("total")).first()[0] == dec("9780.00") + dec("4655.00")
    top = r.top_expense_categories(totals, 2).orderBy("rank").collect()
    assert [x.category_name for x in top] == ["Housing", "Groceries"]
    split = r.statutory_split(totals, categories).collect()
    assert [(x.statutory, x.total) for x in split] == [(False, dec("4655.00"))]


def test_prior_period(usd, categories):
    may = r.per_category_totals(usd.filter("occurred_on < '2026-06-01'"), categories)
    june = r.per_category_totals(usd.filter("occurred_on >= '2026-06-01'"), categories)
    found = {x.category_name: x.change for x in r.prior_period_delta(june, may).collect()}
    assert found["Housing"] == 0 and found["Transport"] is None
    assert found["Groceries"] == pytest.approx(70 / 410)
    assert "Base salary" not in found


def test_burn_and_savings_rate(spark):
    rates = r.burn_rate(F.lit(dec("300.00")), F.lit(date(2026, 6, 1)), F.lit(date(2026, 6, 30)))
    burn = spark.range(1).select(rates.alias("b")).first().b
    assert burn.per_day == 10 and burn.per_week == 70 and burn.per_month == pytest.approx(304.4)
    one = spark.range(1)
    none = F.lit(None).cast("date")
    assert one.select(r.burn_rate(F.lit(dec(1)), none, none)).first()[0] is None
    pairs = [("100.00", "30.00", "0.7"), ("0.00", "5.00", "0"), ("-10.00", "5.00", "0")]
    for reference, expense, expected in pairs:
        rate = r.savings_rate(F.lit(dec(reference)), F.lit(dec(expense)))
        assert one.select(rate).first()[0] == dec(expected)


def summary_of(spark, users, tx, categories, matrix, salary=None, **filters):
    rows = [("US", salary, "monthly")] if salary else []
    stored = profile_snapshot(
        profiles(spark, *rows) if rows else profiles(spark, ("US", 1, "annual")).limit(0)
    )
    return dashboards.overview(users, tx, categories, stored, matrix, **filters)


def keys(summary):
    found = insights.insights(dashboards.insight_summary(summary)).orderBy("user_id", "position")
    return [(x.user_id, x.key, x.detail) for x in found.collect()]


def test_overview_and_dashboard(spark, users, demo, categories, matrix):
    base = summary_of(spark, users, demo, categories, matrix, salary=6000, start="2026-06-01")
    one, two = base.orderBy("user_id").collect()
    assert (one.total_income, one.total_expense, one.net_cashflow) == (5190, 2595, 2595)
    # 72,000 a year: tax 7,454.00, Social Security 4,464.00, Medicare 1,044.00.
    assert one.salary_net == dec("4919.83") and one.deduction_rate == dec("0.1800")
    assert one.savings_rate == dec("0.4725")
    assert len(one.categories) == 8
    assert (two.total_income, two.salary_net, two.savings_rate, two.currency) == (0, None, 0, "EUR")
    stored = profile_snapshot(profiles(spark, ("US", 6000, "monthly")))
    board = dashboards.dashboard(users, demo, categories, stored, matrix, "php", start="2026-06-01")
    row = board.filter("user_id = 1").first()
    assert row.total_income == 5190 * 58 and row.currency == "PHP"
    assert [c.category_name for c in row.top_expense_categories][:2] == ["Housing", "Groceries"]
    assert len(row.top_expense_categories) == 5 and len(row.insights) >= 1


def test_findings(spark, users, demo, categories, matrix):
    found = keys(summary_of(spark, users, demo, categories, matrix, start="2026-06-01"))
    assert [(u, k) for u, k, _ in found] == [
        (1, "healthy_savings"), (1, "concentrated_spend"), (1, "multiple_income_streams"), (2, "no_signal"),
    ]
    assert found[0][2] == "Saving 50% of your reference income this period."
    assert found[1][2] == "58% of expenses went to Housing (1500.00 USD)."


def test_overspend_and_tiny_overspend(spark, users, categories, matrix):
    day = date(2026, 6, 1)
    over = transactions(spark, [(1, 1, 1, "100.00", day, None), (2, 1, 4, "150.00", day, None)])
    (first, *_) = keys(summary_of(spark, users, over, categories, matrix))
    assert first[1:] == (
        "overspend",
        "Expenses (150.00 USD) are above your reference income (100.00 USD) for this period.",
    )
    tiny = transactions(spark, [(1, 1, 1, "1000.00", day, None), (2, 1, 4, "1000.01", day, None)])
    (first, *_) = keys(summary_of(spark, users, tiny, categories, matrix))
    assert first[1:] == ("low_savings", "Saving -0% of income. A common target is 20%+.")
    idle = transactions(spark, [(1, 1, 1, "100.00", day, None)])
    assert [k for u, k, _ in keys(summary_of(spark, users, idle, categories, matrix)) if u == 1] == [
        "healthy_savings", "no_expenses_yet",
    ]


def test_uncategorized_direction_is_of_the_first_row(spark, matrix):
    empty = spark.createDataFrame([], CATEGORIES)
    rows = transactions(spark, [(2, 1, 4, 5, ANCHOR, None), (1, 1, 4, 7, ANCHOR, None)])
    mixed = rows.withColumn("direction", F.when(F.col("id") == 1, "inbound").otherwise("outbound"))
    (row,) = r.per_category_totals(fx.to_display(mixed, matrix, "USD"), empty).collect()
    assert (row.category_name, row.direction, row.total) == ("Uncategorized", "inbound", 12)
