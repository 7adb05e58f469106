"""One local session, and the small demo ledger the expected figures refer to."""

from __future__ import annotations

import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from purseflow.operators.fx import rate_matrix  # noqa: E402
from purseflow.operators.skew import pinned  # noqa: E402
from purseflow.session import build_session  # noqa: E402
from purseflow.sources.seeds import reference_rates  # noqa: E402

TX = (
    "id bigint, user_id bigint, direction string, category_id int, amount decimal(14,2), "
    "currency string, region string, occurred_on date, occurred_time string"
)
CATEGORIES = "id int, name string, direction string, statutory boolean"
BUDGETS = "user_id bigint, category_id int, year int, month int, limit_amount decimal(14,2), currency string"


def dec(text) -> Decimal:
    return Decimal(str(text))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def matrix(spark):
    return pinned(rate_matrix(reference_rates(spark)))


@pytest.fixture(scope="session")
def users(spark):
    rows = [(1, "one", "USD", "US"), (2, "two", "EUR", "EU")]
    return spark.createDataFrame(
        rows, "id bigint, name string, base_currency string, default_region string"
    )


@pytest.fixture(scope="session")
def categories(spark):
    names = [
        (1, "Base salary", "inbound"),
        (2, "Freelance income", "inbound"),
        (3, "Housing", "outbound"),
        (4, "Groceries", "outbound"),
        (5, "Dining", "outbound"),
        (6, "Transport", "outbound"),
        (7, "Subscriptions", "outbound"),
        (8, "Utilities", "outbound"),
    ]
    return spark.createDataFrame([(*row, False) for row in names], CATEGORIES)


def transactions(spark, rows):
    """(id, user, category, amount, day, time) rows; categories 1 and 2 are income."""
    full = [
        (
            key,
            user,
            "inbound" if category in (1, 2) else "outbound",
            category,
            dec(amount),
            "USD",
            "US",
            day,
            time,
        )
        for key, user, category, amount, day, time in rows
    ]
    return spark.createDataFrame(full, TX)


@pytest.fixture(scope="session")
def demo(spark):
    """A prior month (net 2530) and the current month, 2026-06."""
    may, june = (lambda d: date(2026, 5, d)), (lambda d: date(2026, 6, d))
    rows = [
        (1, 1, 1, "4590.00", may(1), "09:00:00"),
        (2, 1, 3, "1500.00", may(2), "08:05:00"),
        (3, 1, 4, "410.00", may(5), "11:05:00"),
        (4, 1, 5, "150.00", may(10), "19:00:00"),
        (5, 1, 1, "4590.00", june(1), "09:00:00"),
        (6, 1, 2, "600.00", june(6), "17:45:00"),
        (7, 1, 3, "1500.00", june(2), "08:05:00"),
        (8, 1, 4, "480.00", june(4), "11:20:00"),
        (9, 1, 5, "220.00", june(7), "19:30:00"),
        (10, 1, 6, "160.00", june(8), "07:50:00"),
        (11, 1, 7, "55.00", june(9), "21:15:00"),
        (12, 1, 8, "180.00", june(10), "14:40:00"),
    ]
    return transactions(spark, rows)


@pytest.fixture(scope="session")
def demo_budgets(spark):
    rows = [
        (1, 4, 2026, 6, dec(500), "USD"),
        (1, 4, 2026, 5, dec(480), "USD"),
        (1, 4, 2026, 4, dec(480), "USD"),
    ]
    return spark.createDataFrame(rows, BUDGETS)
