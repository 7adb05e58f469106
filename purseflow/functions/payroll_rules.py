"""Gross-to-net rules, the registry that holds them, and the column arithmetic they need.

A rule is data: contributions, brackets and labels. The payroll operator picks the constants of
a row's region by index out of literal arrays, so that one short piece of arithmetic serves all
regions. Figures are planning approximations of national rules, not filing advice. The tax year
is a label: no rule reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import add

from pyspark.sql import Column, functions as F

TAX, SOCIAL, INFO = "tax", "social", "info"
DEFAULT_TAX_YEAR = 2025

Bracket = tuple[str, str]


def exact(text: str | int) -> Column:
    return F.lit(Decimal(str(text)))


def choose(values: Sequence[str | None], index: Column, kind: str) -> Column:
    """The value at a 1-based index of a literal decimal array; NULL for None."""
    cells = [F.lit(None if v is None else Decimal(v)).cast(kind) for v in values]
    return F.element_at(F.array(*cells), index)


def bracket_tax(income: Column, schedules: Sequence[Sequence[Bracket]], which: Column) -> Column:
    """Marginal tax by the schedule with the given 1-based number; NULL for an empty schedule.

    Within a bracket the tax is income times its rate less a fixed amount, which is worked out
    here once; a row then needs one product, whatever the number of brackets.
    """
    width = max(len(schedule) for schedule in schedules)
    rates: list[str | None] = []
    offsets: list[str | None] = []
    for schedule in schedules:
        offset, before = Decimal(0), Decimal(0)
        for lower, rate in schedule:
            offset += Decimal(lower) * (Decimal(rate) - before)
            before = Decimal(rate)
            rates.append(rate)
            offsets.append(str(offset))
        padding = [None] * (width - len(schedule))
        rates, offsets = rates + padding, offsets + padding
    bounds = [
        choose([s[i][0] if i < len(s) else None for s in schedules], which, "decimal(14,2)")
        for i in range(1, width)
    ]
    passed = reduce(add, [F.when(income > bound, 1).otherwise(0) for bound in bounds], F.lit(0))
    place = ((which - 1) * width + passed + 1).cast("int")
    rate, offset = choose(rates, place, "decimal(6,5)"), choose(offsets, place, "decimal(18,6)")
    return F.when(rate.isNotNull(), F.greatest(income * rate - offset, exact(0)))


def progressive_tax(income: Column, brackets: Sequence[Bracket]) -> Column:
    """Marginal tax for ascending (lower bound, rate) brackets from 0; 0 for income up to 0."""
    return bracket_tax(income, [brackets], F.lit(1))


def capped_contribution(
    income: Column, rate: str, floor: str | None = None, ceiling: str | None = None
) -> Column:
    """A percentage of income clamped to [floor, ceiling]."""
    base = F.greatest(income, exact(floor or 0))
    return (base if ceiling is None else F.least(base, exact(ceiling))) * exact(rate)


@dataclass(frozen=True)
class Contribution:
    """A percentage of the gross clamped to [floor, ceiling].

    ``only_above``: due on the whole gross, but only once it passes this amount.
    ``extra_rate`` is due on top for the part above ``extra_above``.
    """

    key: str
    label: str
    rate: str
    floor: str | None = None
    ceiling: str | None = None
    only_above: str | None = None
    extra_rate: str | None = None
    extra_above: str | None = None
    kind: str = SOCIAL


@dataclass(frozen=True)
class PayrollRule:
    """One region. ``brackets``, or a ``tariff`` column function of the taxable income."""

    region: str
    currency: str
    modelled_as: str
    contributions: tuple[Contribution, ...] = ()
    brackets: tuple[Bracket, ...] = ()
    tariff: Callable[[Column], Column] | None = None
    deduction: str = "0"
    social_is_deductible: bool = False
    tax_key: str = "income_tax"
    tax_label: str = "Income tax"
    tax_comes_first: bool = True
    gross_label: str = "Gross salary"
    net_label: str = "Net take-home"


# --------------------------------------------------------------------------- fixed values
# Brackets are (annual lower bound, marginal rate); contributions are (rate, floor, ceiling).

PH_BRACKETS = (
    ("0", "0"),
    ("250000", "0.15"),
    ("400000", "0.20"),
    ("800000", "0.25"),
    ("2000000", "0.30"),
    ("8000000", "0.35"),
)
PH_SSS = ("0.045", "48000", "360000")
PH_PHILHEALTH = ("0.025", "120000", "1200000")
PH_PAGIBIG = ("0.02", None, "60000")

US_BRACKETS = (
    ("0", "0.10"),
    ("11925", "0.12"),
    ("48475", "0.22"),
    ("103350", "0.24"),
    ("197300", "0.32"),
    ("250525", "0.35"),
    ("626350", "0.37"),
)
US_STANDARD_DEDUCTION = "15000"
US_SOCIAL_SECURITY = ("0.062", None, "176100")
US_MEDICARE_RATE = "0.0145"
US_EXTRA_MEDICARE_RATE = "0.009"
US_EXTRA_MEDICARE_ABOVE = "200000"

AU_BRACKETS = (
    ("0", "0"),
    ("18200", "0.16"),
    ("45000", "0.30"),
    ("135000", "0.37"),
    ("190000", "0.45"),
)
AU_LEVY_RATE = "0.02"
AU_LEVY_ABOVE = "27222"
AU_SUPER_RATE = "0.115"

DE_PENSION = ("0.093", None, "90600")
DE_HEALTH = ("0.0815", None, "62100")
DE_UNEMPLOYMENT = ("0.013", None, "90600")
DE_CARE = ("0.017", None, "62100")
# Zones of the German tariff: bounds, then the coefficients of each zone's formula.
DE_ZONE_BOUNDS = ("11604", "17005", "66760", "277825")
DE_ZONE_2 = ("922.98", "1400")
DE_ZONE_3 = ("181.19", "2397", "1025.38")
DE_ZONE_4 = ("0.42", "10602.13")
DE_ZONE_5 = ("0.45", "18936.88")
# -----------------------------------------------------------------------------------------


def german_tariff(income: Column) -> Column:
    """Five-zone tariff: nothing, two quadratic zones, two linear zones."""
    bounds = [exact(bound) for bound in DE_ZONE_BOUNDS]

    def ten_thousands(low: Column, high: Column) -> Column:
        # Clamped to the zone first, so that the product stays within decimal precision.
        inside = F.least(F.greatest(income, low), high) - low
        return (inside * exact("0.0001")).cast("decimal(9,6)")

    y, z = ten_thousands(bounds[0], bounds[1]), ten_thousands(bounds[1], bounds[2])
    zone_2 = (exact(DE_ZONE_2[0]) * y + exact(DE_ZONE_2[1])) * y
    zone_3 = (exact(DE_ZONE_3[0]) * z + exact(DE_ZONE_3[1])) * z + exact(DE_ZONE_3[2])
    zone_4 = exact(DE_ZONE_4[0]) * income - exact(DE_ZONE_4[1])
    zone_5 = exact(DE_ZONE_5[0]) * income - exact(DE_ZONE_5[1])
    tariff = (
        F.when(income <= bounds[0], exact(0))
        .when(income <= bounds[1], zone_2)
        .when(income <= bounds[2], zone_3)
        .when(income <= bounds[3], zone_4)
        .otherwise(zone_5)
    )
    return F.greatest(tariff, exact(0))


PHILIPPINES = PayrollRule(
    "PH",
    "PHP",
    "Philippines (national)",
    (
        Contribution("sss", "SSS", *PH_SSS),
        Contribution("philhealth", "PhilHealth", *PH_PHILHEALTH),
        Contribution("pagibig", "Pag-IBIG", *PH_PAGIBIG),
    ),
    PH_BRACKETS,
    social_is_deductible=True,
    tax_comes_first=False,
)
UNITED_STATES = PayrollRule(
    "US",
    "USD",
    "United States (federal)",
    (
        Contribution("social_security", "Social Security", *US_SOCIAL_SECURITY),
        Contribution(
            "medicare",
            "Medicare",
            US_MEDICARE_RATE,
            extra_rate=US_EXTRA_MEDICARE_RATE,
            extra_above=US_EXTRA_MEDICARE_ABOVE,
        ),
    ),
    US_BRACKETS,
    deduction=US_STANDARD_DEDUCTION,
    tax_key="federal_income_tax",
    tax_label="Federal income tax",
    gross_label="Gross wages",
)
AUSTRALIA = PayrollRule(
    "AU",
    "AUD",
    "Australia (national)",
    (
        Contribution("medicare_levy", "Medicare levy", AU_LEVY_RATE, only_above=AU_LEVY_ABOVE),
        # Paid by the employer on top of the salary: shown, not deducted.
        Contribution("super", "Superannuation (employer)", AU_SUPER_RATE, kind=INFO),
    ),
    AU_BRACKETS,
    tax_label="Income tax (PAYG)",
)
GERMANY = PayrollRule(
    "EU",
    "EUR",
    "Germany (EU representative)",
    (
        Contribution("pension", "Pension insurance", *DE_PENSION),
        Contribution("health", "Health insurance", *DE_HEALTH),
        Contribution("unemployment", "Unemployment insurance", *DE_UNEMPLOYMENT),
        Contribution("care", "Long-term care insurance", *DE_CARE),
    ),
    tariff=german_tariff,
    tax_label="Income tax (Lohnsteuer)",
)

RuleSet = dict[str, PayrollRule]

RULES: RuleSet = {
    rule.region: rule for rule in (PHILIPPINES, UNITED_STATES, AUSTRALIA, GERMANY)
}


def with_rule(rule: PayrollRule, rules: RuleSet = RULES) -> RuleSet:
    """A rule set extended (or overridden) by one more region."""
    return {**rules, rule.region: rule}


def supported_regions(rules: RuleSet = RULES) -> list[str]:
    return sorted(rules)
