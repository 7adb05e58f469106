"""Reference rows every ledger starts with; rows already present are left untouched."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from purseflow.functions.periods import as_day
from purseflow.schemas import INBOUND, OUTBOUND, PIVOT_CURRENCY, REGION_CURRENCY
from purseflow.session import small_table

# --------------------------------------------------------------------------- fixed values
JURISDICTIONS = [
    ("PH", "Philippines", "Philippines (national)"),
    ("US", "United States", "United States (federal)"),
    ("AU", "Australia", "Australia (national)"),
    ("EU", "European Union", "Germany (EU representative)"),
]
USD_RATES = {"PHP": "58.00", "AUD": "1.52", "EUR": "0.92"}
INBOUND_CATEGORIES = [
    "Base salary",
    "Overtime",
    "Bonus",
    "Commission",
    "Allowances",
    "Reimbursements",
    "Dividends",
    "Interest",
    "Freelance income",
    "Other income",
]
OUTBOUND_CATEGORIES = [
    "Housing",
    "Utilities",
    "Groceries",
    "Dining",
    "Transport",
    "Healthcare",
    "Insurance",
    "Education",
    "Debt repayment",
    "Savings & investment",
    "Entertainment",
    "Shopping",
    "Subscriptions",
    "Travel",
    "Family & dependents",
    "Charity",
    "Miscellaneous",
]
STATUTORY_CATEGORIES = {
    "PH": ["Income tax", "SSS", "PhilHealth", "Pag-IBIG"],
    "US": ["Federal income tax", "Social Security", "Medicare"],
    "AU": ["Income tax", "Medicare levy"],
    "EU": [
        "Income tax",
        "Pension insurance",
        "Health insurance",
        "Unemployment insurance",
        "Long-term care insurance",
    ],
}
# -----------------------------------------------------------------------------------------


def seed_category_rows() -> list[tuple[str, str, bool, str | None]]:
    """(name, direction, statutory, region) of every reference category."""
    rows = [(name, INBOUND, False, None) for name in INBOUND_CATEGORIES]
    rows += [(name, OUTBOUND, False, None) for name in OUTBOUND_CATEGORIES]
    for region, names in STATUTORY_CATEGORIES.items():
        rows += [(f"{name} ({region})", OUTBOUND, True, region) for name in names]
    return rows


def seed_categories(existing: DataFrame) -> DataFrame:
    """Existing categories plus the missing reference ones, numbered after the highest id."""
    rows = [(n, *row) for n, row in enumerate(seed_category_rows(), start=1)]
    seeds = small_table(
        existing.sparkSession,
        rows,
        "position int, name string, direction string, statutory boolean, region string",
    )
    missing = seeds.join(existing, ["name", "direction"], "left_anti")
    return _added(existing, missing.withColumn("is_system", F.lit(True)), "position")


def _added(existing: DataFrame, missing: DataFrame, order: str) -> DataFrame:
    """The missing reference rows below the existing ones, whose columns they take.

    Ids go on from the highest one without gaps; other columns that a reference row has no value
    for are NULL. Reference rows are a few constants, so one task numbers them.
    """
    kinds = dict(existing.dtypes)
    if "id" in kinds:
        highest = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar()
        number = F.row_number().over(Window.orderBy(order))
        missing = missing.withColumn("_n", number).withColumn("id", highest + F.col("_n"))
    columns = [
        (F.col(name) if name in missing.columns else F.lit(None)).cast(kind).alias(name)
        for name, kind in kinds.items()
    ]
    return existing.unionByName(missing.select(*columns))


def seed_rates(existing: DataFrame, as_of: date | Column) -> DataFrame:
    """Existing current rates plus the missing USD ones."""
    seeds = reference_rates(existing.sparkSession).withColumn("as_of", as_day(as_of))
    pair = ["base_currency", "quote_currency"]
    return _added(existing, seeds.join(existing, pair, "left_anti"), "quote_currency")


def seed_jurisdictions(existing: DataFrame) -> DataFrame:
    rows = [(r, name, REGION_CURRENCY[r], label, True) for r, name, label in JURISDICTIONS]
    seeds = small_table(
        existing.sparkSession,
        rows,
        "region string, name string, currency string, modelled_as string, supported boolean",
    )
    return _added(existing, seeds.join(existing, "region", "left_anti"), "region")


def reference_rates(spark: SparkSession) -> DataFrame:
    """The USD reference rates alone, for ledgers without a rate table."""
    rows = [(PIVOT_CURRENCY, quote, Decimal(rate)) for quote, rate in USD_RATES.items()]
    columns = "base_currency string, quote_currency string, rate decimal(18,8)"
    return small_table(spark, rows, columns)
