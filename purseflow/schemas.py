"""Table schemas and enumerations of the ledger model.

Fixed values: enum members, region currencies and column types.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
RATE = T.DecimalType(18, 8)
TOTAL = T.DecimalType(18, 2)
MATRIX_RATE = T.DecimalType(22, 16)

INBOUND = "inbound"
OUTBOUND = "outbound"
REGIONS = ("PH", "US", "AU", "EU")
SCOPES = ("month", "3m", "ytd", "all")
TIME_RANGES = ("this_month", "last_3m", "ytd", "all")
PAY_PERIODS = ("monthly", "annual")
REGION_CURRENCY = {"PH": "PHP", "US": "USD", "AU": "AUD", "EU": "EUR"}
PIVOT_CURRENCY = "USD"

# Stored transactions carry the first day of their month as a partition column.
MONTH_COLUMN = "month"

# Databases that store enum *names* are normalised to these values on read.
ENUM_VALUES = {
    "direction": {"INBOUND": "inbound", "OUTBOUND": "outbound"},
    "scope": {"MONTH": "month", "QUARTER": "3m", "YTD": "ytd", "ALL": "all"},
    "pay_period": {"MONTHLY": "monthly", "ANNUAL": "annual"},
}


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


_LONG, _INT, _STR = T.LongType(), T.IntegerType(), T.StringType()
_DATE, _BOOL, _NTZ = T.DateType(), T.BooleanType(), T.TimestampNTZType()

PAYROLL_ITEM = _table(("key", _STR), ("label", _STR), ("amount", TOTAL), ("kind", _STR))
BREAKDOWN = _table(
    ("region", _STR),
    ("currency", _STR),
    ("tax_year", _INT),
    ("pay_period", _STR),
    ("gross_annual", TOTAL),
    ("net_annual", TOTAL),
    ("gross_period", TOTAL),
    ("net_period", TOTAL),
    ("total_tax", TOTAL),
    ("total_social", TOTAL),
    ("total_deductions", TOTAL),
    ("effective_rate", T.DecimalType(20, 4)),
    ("items", T.ArrayType(PAYROLL_ITEM)),
)

TABLES: dict[str, T.StructType] = {
    "users": _table(
        ("id", _LONG),
        ("name", _STR),
        ("email", _STR),
        ("base_currency", _STR),
        ("default_region", _STR),
        ("created_at", _NTZ),
    ),
    "transactions": _table(
        ("id", _LONG),
        ("user_id", _LONG),
        ("direction", _STR),
        ("category_id", _INT),
        ("amount", MONEY),
        ("currency", _STR),
        ("region", _STR),
        ("occurred_on", _DATE),
        ("occurred_time", _STR),
        ("description", _STR),
        ("created_at", _NTZ),
    ),
    "categories": _table(
        ("id", _INT),
        ("name", _STR),
        ("direction", _STR),
        ("statutory", _BOOL),
        ("region", _STR),
        ("is_system", _BOOL),
        ("user_id", _LONG),
    ),
    "budgets": _table(
        ("id", _LONG),
        ("user_id", _LONG),
        ("category_id", _INT),
        ("year", _INT),
        ("month", _INT),
        ("limit_amount", MONEY),
        ("currency", _STR),
    ),
    "fund_overrides": _table(
        ("id", _LONG),
        ("user_id", _LONG),
        ("scope", _STR),
        ("period_start", _DATE),
        ("amount", MONEY),
        ("currency", _STR),
        ("created_at", _NTZ),
        ("updated_at", _NTZ),
    ),
    "salary_profiles": _table(
        ("id", _LONG),
        ("user_id", _LONG),
        ("label", _STR),
        ("region", _STR),
        ("currency", _STR),
        ("gross_amount", MONEY),
        ("pay_period", _STR),
        ("tax_year", _INT),
        ("net_amount", MONEY),
        ("total_deductions", MONEY),
        ("breakdown", _STR),
        ("is_active", _BOOL),
        ("created_at", _NTZ),
        ("updated_at", _NTZ),
    ),
    "exchange_rates": _table(
        ("id", _LONG),
        ("base_currency", _STR),
        ("quote_currency", _STR),
        ("rate", RATE),
        ("as_of", _DATE),
    ),
    "exchange_rate_history": _table(
        ("id", _LONG),
        ("base_currency", _STR),
        ("quote_currency", _STR),
        ("rate", RATE),
        ("as_of", _DATE),
    ),
    "jurisdictions": _table(
        ("id", _LONG),
        ("region", _STR),
        ("name", _STR),
        ("currency", _STR),
        ("modelled_as", _STR),
        ("supported", _BOOL),
    ),
}
