import pytest
from pyspark.sql import functions as F

from conftest import dec
from purseflow.functions.payroll_rules import (
    PayrollRule,
    exact,
    progressive_tax,
    supported_regions,
    with_rule,
)
from purseflow.operators import payroll as pay

PROFILE = (
    "id bigint, user_id bigint, region string, currency string, gross_amount decimal(14,2), "
    "pay_period string, tax_year int, is_active boolean, updated_at timestamp_ntz"
)


def profiles(spark, *rows):
    """(region, gross, pay period) rows."""
    full = [
        (i, 1, region, "USD", dec(gross), period, None, True, None)
        for i, (region, gross, period) in enumerate(rows, start=1)
    ]
    return spark.createDataFrame(full, PROFILE)


def breakdowns(spark, *rows):
    paid = pay.with_breakdown(profiles(spark, *rows)).orderBy("id")
    return [row.breakdown for row in paid.collect()]


def test_progressive_tax_bounds(spark):
    steps = [("0", "0"), ("1000", "0.10"), ("2000", "0.20")]
    incomes = spark.createDataFrame([(dec(x),) for x in (0, -50, 1500, 3000)], "x decimal(14,2)")
    taxes = [r[0] for r in incomes.select(progressive_tax(F.col("x"), steps)).collect()]
    assert taxes == [0, 0, 50, 300]


@pytest.mark.parametrize(
    "region, tax, social, net",
    [
        ("US", "5161.50", "4590.00", "50248.50"),
        ("PH", "0.00", "6900.00", "53100.00"),
        ("AU", "8788.00", "1200.00", "50012.00"),
        ("EU", "14680.71", "12270.00", "33049.29"),
    ],
)
def test_sixty_thousand_a_year(spark, region, tax, social, net):
    (b,) = breakdowns(spark, (region, 60000, "annual"))
    assert (b.total_tax, b.total_social, b.net_annual) == (dec(tax), dec(social), dec(net))
    assert b.tax_year == 2025


def test_super_is_shown_but_not_deducted(spark):
    (b,) = breakdowns(spark, ("AU", 60000, "annual"))
    assert [item.key for item in b["items"]] == ["gross", "income_tax", "medicare_levy", "net", "super"]
    assert b["items"][-1].kind == "info"
    assert b.net_annual == b.gross_annual - b.total_deductions


def test_net_and_deductions_make_gross(spark):
    for b in breakdowns(spark, *[(r, 90000, "annual") for r in supported_regions()]):
        assert b.net_annual + b.total_deductions == b.gross_annual


def test_effective_rate_does_not_fall(spark):
    regions = supported_regions()
    low = breakdowns(spark, *[(r, 200000, "annual") for r in regions])
    high = breakdowns(spark, *[(r, 2000000, "annual") for r in regions])
    assert all(h.effective_rate >= s.effective_rate for h, s in zip(high, low))


def test_monthly_equals_annual(spark):
    monthly, annual = breakdowns(spark, ("US", 5000, "monthly"), ("US", 60000, "annual"))
    assert monthly.net_annual == annual.net_annual
    assert monthly.net_period == dec("4187.38")  # 50248.50 / 12 = 4187.375
    assert annual.net_period == annual.net_annual


def test_small_incomes_keep_their_quirks(spark):
    ph, us = breakdowns(spark, ("PH", 1200, "annual"), ("US", 10, "annual"))
    assert ph.net_annual == dec("-3984.00")
    assert (us.total_deductions, us.net_annual) == (dec("0.77"), dec("9.24"))


# German tariff at the zone borders, one euro beyond them, and inside the zones.
TARIFF = {
    11604: "0.00",
    11605: "0.14",
    17005: "1025.38",
    17006: "1025.62",
    40000: "7495.36",
    66760: "17437.12",
    66761: "17437.49",
    277825: "106084.37",
    277826: "106084.82",
    500000: "206063.12",
}


def test_tariff_zones(spark):
    found = breakdowns(spark, *[("EU", income, "annual") for income in TARIFF])
    assert [b.total_tax for b in found] == [dec(tax) for tax in TARIFF.values()]


def test_unknown_region_and_gross_are_rejected(spark):
    paid, rejected = pay.payroll_run(
        profiles(spark, ("US", 100, "annual"), ("XX", 100, "annual"), ("US", 0, "annual"))
    )
    assert [r.id for r in paid.collect()] == [1]
    assert {r.id: r.reason for r in rejected.collect()} == {
        2: "no rule for the region",
        3: "gross must be positive",
    }


def test_a_rule_can_be_added(spark):
    flat = PayrollRule("XX", "USD", "flat", brackets=(("0", "0.10"),))
    own = PayrollRule("YY", "USD", "own", tariff=lambda x: x * exact("0.25"))
    rules = with_rule(own, with_rule(flat))
    assert supported_regions(rules) == ["AU", "EU", "PH", "US", "XX", "YY"]
    two = profiles(spark, ("XX", 1000, "annual"), ("YY", 1000, "annual"))
    nets = [r.breakdown.net_annual for r in pay.with_breakdown(two, rules).orderBy("id").collect()]
    assert nets == [900, 750]


def test_payslip_lines(spark):
    paid = pay.with_breakdown(profiles(spark, ("US", 60000, "annual")))
    lines = {r.key: r.amount for r in pay.payroll_items(paid, "period").collect()}
    assert "net" not in lines
    assert lines["gross"] == 5000 and lines["federal_income_tax"] == dec("-430.13")


def test_snapshot_json_round_trip(spark):
    stored = pay.profile_snapshot(profiles(spark, ("EU", 60000, "annual"))).withColumn(
        "breakdown", pay.breakdown_json(F.col("breakdown"))
    )
    (row,) = pay.stored_salary_figures(stored).collect()
    assert (row.salary_currency, row.net_period) == ("EUR", dec("33049.29"))
    bare = stored.withColumn("breakdown", F.lit("{}"))
    assert pay.stored_salary_figures(bare).first().net_period == 0
