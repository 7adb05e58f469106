from datetime import date

from pyspark.sql import functions as F

from conftest import BUDGETS, dec
from purseflow.functions import periods as p
from purseflow.operators import budgets as b


def value(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return tuple(row)


def bounds(spark, scope, anchor):
    return value(spark, p.period_start(scope, anchor), p.period_end(scope, anchor))


def test_scope_bounds(spark):
    assert bounds(spark, "month", date(2026, 6, 15)) == (date(2026, 6, 1), date(2026, 7, 1))
    assert bounds(spark, "3m", date(2026, 1, 10)) == (date(2025, 11, 1), date(2026, 2, 1))
    assert bounds(spark, "ytd", date(2026, 3, 20)) == (date(2026, 1, 1), date(2026, 4, 1))
    months = p.months_between(F.lit(date(2025, 11, 1)), F.lit(date(2026, 2, 1)))
    assert value(spark, months)[0] == [date(2025, 11, 1), date(2025, 12, 1), date(2026, 1, 1)]


def test_previous_period_end(spark):
    ends = [
        p.previous_period_end("month", date(2026, 6, 15)),
        p.previous_period_end("3m", date(2026, 1, 10)),
        p.previous_period_end("ytd", date(2026, 3, 20)),
        p.previous_period_end("all", date(2026, 3, 20)),
    ]
    assert value(spark, *ends) == (date(2026, 5, 31), date(2025, 10, 31), date(2025, 12, 31), None)


def test_all_scope_spans_budgeted_months(spark, users):
    rows = [(1, 1, 2025, 11, dec(100), "USD"), (1, 1, 2026, 3, dec(100), "USD")]
    budgets = spark.createDataFrame(rows, BUDGETS)
    found = {
        r.user_id: (r.period_start, r.period_end, r.month_count)
        for r in b.period_bounds(users, budgets, "all", date(2026, 5, 1)).collect()
    }
    assert found[1] == (date(2025, 11, 1), date(2026, 4, 1), 2)
    assert found[2] == (date(2026, 5, 1), date(2026, 6, 1), 0)


def test_report_ranges(spark):
    today = date(2026, 6, 15)
    assert value(spark, *p.time_range_bounds("last_3m", today)) == (date(2026, 4, 1), date(2026, 6, 30))
    assert value(spark, *p.time_range_bounds("ytd", today)) == (date(2026, 1, 1), today)
    assert value(spark, *p.time_range_bounds("all", today)) == (None, None)
    assert value(spark, *p.previous_range_bounds("this_month", today)) == (
        date(2026, 5, 2),
        date(2026, 5, 31),
    )
    assert value(spark, p.months_for_range("ytd", today), p.months_for_range("all", today)) == (6, 36)


def test_rate_ranges(spark):
    end = date(2026, 7, 6)
    assert value(spark, p.fx_range_bounds(None, end)[0]) == (date(2026, 6, 30),)
    assert value(spark, p.fx_range_bounds(date(2023, 10, 10), end)[0]) == (date(2025, 7, 6),)
    assert value(spark, *p.fx_preset_bounds("all", end)) == (date(2025, 7, 6), end)


def test_fund_start_and_month_shift(spark):
    anchor = date(2026, 6, 15)
    assert value(spark, p.fund_period_start("all", anchor)) == (date(1970, 1, 1),)
    shifted = p.shift_months(F.lit(2026), F.lit(1), -2)
    assert value(spark, *shifted) == (2025, 11)
