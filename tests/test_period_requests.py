"""Requests with their own scope and anchor against the one-anchor operators, user by user."""

from datetime import date, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from conftest import BUDGETS, dec, transactions
from purseflow.operators import balances, budgets as b, fx, period_requests as asked, skew
from purseflow.schemas import SCOPES
from purseflow.sources import tables

ASK = "user_id bigint, scope string, anchor date"


@pytest.fixture(scope="module")
def year(spark):
    """A year and a half of rows of two users, some in other currencies."""
    random = Random(2)
    rows = [
        (i, 1 + i % 2, random.choice([1, 3, 4, 5]), f"{random.randrange(1, 9000) / 100:.2f}",
         date(2025, 1, 1) + timedelta(random.randrange(540)), "10:00:00")
        for i in range(400)
    ]
    codes = F.array(*[F.lit(c) for c in ("USD", "EUR", "PHP")])
    return transactions(spark, rows).withColumn(
        "currency", F.element_at(codes, (F.col("id") % 3 + 1).cast("int"))
    )


@pytest.fixture(scope="module")
def limits(spark):
    """Budgets in changing currencies; user 2 has gaps, category 5 stops early."""
    rows = []
    for m in range(18):
        y, mth = 2025 + m // 12, m % 12 + 1
        rows.append((1, 4, y, mth, dec(50 + m), "USD" if m < 9 else "EUR"))
        if m % 3:
            rows.append((2, 3, y, mth, dec(70), "PHP" if m % 2 else "USD"))
        if m < 5:
            rows.append((1, 5, y, mth, dec(10), "EUR"))
    return spark.createDataFrame(rows, BUDGETS)


@pytest.fixture(scope="module")
def requests(spark):
    days = [date(2025, 3, 31), date(2025, 12, 1), date(2026, 2, 14), date(2026, 6, 30)]
    rows = [(u, s, d) for u in (1, 2) for s in SCOPES for d in days[: 2 + u]]
    rows += rows[:3] + [(1, "3m", date(2025, 12, 20)), (99, "ytd", days[0])]
    return spark.createDataFrame(rows, ASK)


def same_rows(found, expected, columns):
    pick = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    assert pick(found) == pick(expected)


def test_status_equals_one_anchor_at_a_time(year, limits, requests, categories, matrix):
    good, bad = asked.checked_requests(requests)
    assert bad.count() == 0
    found = asked.budget_status_asked(good, limits, year, categories, matrix).cache()
    columns = [c for c in found.columns if c != "anchor"]
    total = 0
    for scope, anchor in good.select("scope", "anchor").distinct().collect():
        users = [r.user_id for r in good.filter((F.col("scope") == scope) & (F.col("anchor") == anchor)).collect()]
        mine = found.filter((F.col("scope") == scope) & (F.col("anchor") == anchor))
        expected = b.budget_status(limits, year, categories, matrix, scope, anchor)
        same_rows(mine, expected.filter(F.col("user_id").isin(users)), columns)
        total += mine.count()
    assert total == found.count() > 20


def test_spend_of_many_pairs_reads_transactions_once(spark, tmp_path, year, limits, requests, matrix, monkeypatch):
    year.write.parquet(f"{tmp_path}/ledger")
    tx = spark.read.schema(year.schema).parquet(f"{tmp_path}/ledger")
    periods = asked.asked_periods(requests, limits)
    wanted = asked.limits_asked(periods, limits, matrix)
    few = asked.spend_asked(wanted, tx, matrix)
    monkeypatch.setattr(skew, "MAX_BROADCAST_KEYS", 1)
    many = asked.spend_asked(wanted, tx, matrix)
    # Staged once; the join would read it for frequent and for other keys.
    reads = lambda df: df._jdf.queryExecution().executedPlan().toString().count(f"{tmp_path}/ledger")
    assert reads(few) == 1 and reads(many) == 0
    same_rows(many, few, few.columns)
    assert few.count() > 5


def test_funds_and_balances_equal_one_anchor_at_a_time(spark, year, limits, requests, users, matrix):
    good, _ = asked.checked_requests(requests)
    overrides = spark.createDataFrame(
        [(1, "ytd", date(2026, 1, 1), dec(500), "PHP"), (2, "all", date(1970, 1, 1), dec(9), "USD")],
        "user_id bigint, scope string, period_start date, amount decimal(14,2), currency string",
    )
    converted = fx.to_display(year, matrix, users=users)
    nets = balances.month_nets(converted)
    funds = asked.fund_status_asked(good, users, limits, overrides, nets).cache()
    daily = asked.balance_with_fund_asked(good, converted, funds).cache()
    assert funds.count() == good.filter("user_id <> 99").count()
    for scope, anchor in good.filter("user_id <> 99").select("scope", "anchor").distinct().collect():
        here = (F.col("scope") == scope) & (F.col("anchor") == anchor)
        askers = [r.user_id for r in good.filter(here).collect()]
        one = b.fund_status(users, limits, overrides, converted, [scope], anchor)
        one = one.filter(F.col("user_id").isin(askers))
        same_rows(funds.filter(here), one, one.columns)
        line = b.balance_with_fund(converted, one, scope, anchor).filter(F.col("user_id").isin(askers))
        same_rows(daily.filter(here), line, ["user_id", "occurred_on", "net", "balance", "balance_with_fund"])


def test_bad_requests_are_told(spark):
    rows = [(1, "week", date(2026, 1, 1)), (1, "3m", None), (None, "3m", date(2026, 1, 1)), (1, None, None)]
    good, bad = asked.checked_requests(spark.createDataFrame(rows, ASK))
    assert good.count() == 0
    assert {(r.scope, r.reason) for r in bad.collect()} == {
        ("week", "unknown scope"), ("3m", "no anchor"), ("3m", "no user"), (None, "unknown scope")}


def test_empty_requests(spark, year, limits, categories, matrix):
    none = spark.createDataFrame([], ASK)
    assert asked.budget_status_asked(none, limits, year, categories, matrix).count() == 0
    assert asked.carry_over_asked(none, balances.month_nets(year.withColumn("amt", F.col("amount")))).count() == 0


def test_one_read_of_the_asked_months(spark, year, limits, categories, matrix, tmp_path):
    """The stored transactions are scanned once, and months that nobody asks for are pruned."""
    tables.write_table(year, str(tmp_path), "transactions")
    stored = tables.read_table(spark, str(tmp_path), "transactions")
    ask = spark.createDataFrame([(1, s, date(2026, 3, 5)) for s in ("month", "3m")], ASK)
    held = asked.asked_budgets(ask, limits)
    spend = asked.spend_asked(
        asked.limits_asked(asked.asked_periods(ask, held), held, matrix), stored, matrix
    )
    spend.collect()
    plan = spend._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = [x for x in plan.split("\n") if "Scan parquet" in x and str(tmp_path) in x]
    assert len(scans) == 1 and "PartitionFilters: [month" in scans[0]
