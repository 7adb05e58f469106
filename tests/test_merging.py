"""Stored columns in upserts, lossless exports, unclamped series, rejects, plans without raw shuffles."""

import csv
import re
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from conftest import BUDGETS, dec, transactions
from purseflow.operators import budgets as b, changes as c, fx
from purseflow.operators.payroll import active_salary
from purseflow.plans import dashboards
from purseflow.sources import csv_export, seeds

CHANGES = "seq bigint, op string, user_id bigint, category_id int, year int, month int, limit_amount decimal(14,2), currency string, id bigint, created_at date, updated_at date"


def test_upserts_keep_ids_and_times(spark, categories, users):
    old, new = date(2020, 1, 1), date(2026, 1, 1)
    base = spark.createDataFrame(
        [(1, 3, 2026, 6, dec(5), "USD", 11, old, old, "x"), (1, 4, 2026, 6, dec(5), "USD", 12, old, old, "y"),
         (1, 5, 2026, 6, dec(5), "USD", 13, old, old, "z")],
        BUDGETS + ", id bigint, created_at date, updated_at date, note string",
    )
    rows = [
        (1, "upsert", 1, 3, 2026, 6, dec(6), None, 91, new, new),  # held: id and creation stay
        (2, "upsert", 1, 6, 2026, 6, dec(7), "eur", 92, new, new),  # new, then changed again
        (3, "upsert", 1, 6, 2026, 6, dec(8), "eur", 93, old, new),
        (4, "delete", 1, 5, 2026, 6, None, None, None, None, None),  # deleted and made anew
        (5, "upsert", 1, 5, 2026, 6, dec(9), "USD", 94, new, new),
    ]
    table, rejected = c.apply_budgets(base, spark.createDataFrame(rows, CHANGES), categories, users)
    assert table.columns == base.columns and rejected.count() == 0
    found = {r.category_id: (r.id, r.limit_amount, r.currency, r.created_at, r.updated_at, r.note) for r in table.collect()}
    assert found == {
        3: (11, dec("6.00"), "USD", old, new, "x"),
        4: (12, dec("5.00"), "USD", old, old, "y"),
        5: (94, dec("9.00"), "USD", new, new, None),
        6: (92, dec("8.00"), "EUR", new, new, None),
    }


def test_seeds_number_without_gaps(spark):
    kinds = "id int, name string, direction string, statutory boolean, region string, is_system boolean, user_id bigint"
    held = spark.createDataFrame([(7, "Groceries", "outbound", False, None, False, 1)], kinds)
    ids = [r.id for r in seeds.seed_categories(held).orderBy("id").collect()]
    assert ids == list(range(7, 7 + len(seeds.seed_category_rows())))


def test_export_is_lossless_for_other_readers(spark, categories, tmp_path):
    notes = ["  padded  ", 'say "hi", now', "two\nlines", "back\\slash", '\\"', "", "plain, text"]
    rows = [(k, 1, 4, 1, date(2026, 6, 1), None) for k in range(len(notes))]
    tx = transactions(spark, rows).withColumn(
        "description", F.element_at(F.array(*map(F.lit, notes)), (F.col("id") + 1).cast("int"))
    )
    path = str(tmp_path / "out")
    csv_export.export_expenses(tx, categories, path)
    back = csv_export.read_export(spark, path, ["user_id", *csv_export.EXPENSE_COLUMNS])
    assert sorted(r.description for r in back.collect()) == sorted(notes)
    lines = []
    for part in sorted(Path(path).glob("part-*.csv")):
        with part.open(newline="") as file:
            lines += [r["description"] for r in csv.DictReader(file)]
    assert sorted(lines) == sorted(notes)


def test_long_history_is_not_clamped(spark):
    days = [date(2024, 1, 1) + timedelta(days=k) for k in range(800)]
    history = spark.createDataFrame(
        [("USD", "EUR", d, dec("0.9")) for d in days],
        "base_currency string, quote_currency string, as_of date, rate decimal(18,8)",
    )
    assert fx.fx_series(history, "usd", days[0], days[-1]).count() == 800
    assert fx.fx_series(history, "usd", days[0], days[-1], max_days=365).count() == 366


def test_insert_rejects(spark, categories, users, demo):
    kinds = "seq bigint, op string, id bigint, user_id bigint, direction string, category_id int, amount decimal(14,2), currency string, region string, occurred_on date, occurred_time string"
    day = date(2026, 6, 1)
    rows = [
        (1, "insert", 1, 1, "outbound", 4, dec(1), "USD", None, day, None),
        (2, "insert", 100, 1, "outbound", 4, dec(-1), "USD", None, day, None),
        (3, "insert", 100, 1, "outbound", 4, dec(1), "USD", None, day, None),
        (4, "insert", 100, 1, "outbound", 4, dec(2), "USD", None, day, None),
        (5, "insert", 101, 77, "outbound", 4, dec(1), None, None, day, None),
        (6, "insert", 102, 77, "outbound", 4, dec(1), None, "AU", day, None),
    ]
    note = F.lit(None).cast("string")
    changes = spark.createDataFrame(rows, kinds).withColumn("description", note)
    changes = changes.withColumn("fields", F.array().cast("array<string>"))
    base = demo.withColumn("description", note)
    table, rejected = c.apply_transactions(base, changes, categories, users)
    assert {r.seq: r.reason for r in rejected.collect()} == {
        1: "id already used",
        2: "amount must be positive",
        4: "id already used",
        5: "no currency",
    }
    assert {r.id: r.amount for r in table.filter("id >= 100").collect()} == {100: dec("1.00"), 102: dec("1.00")}


def exchanged_before_aggregation(df) -> list[str]:
    """Exchanges of the plan that no partial aggregate feeds."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    found = []
    for i, line in enumerate(lines):
        if re.search(r"Exchange hash", line):
            below = " ".join(lines[i + 1 : i + 3])
            if "HashAggregate" not in below and "SortAggregate" not in below:
                found.append(line)
    return found


def test_spend_and_funds_shuffle_sums_only(spark, demo, demo_budgets, categories, users, matrix):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        limits = spark.createDataFrame(
            [(1, 4, dec(5), "EUR", date(2026, 6, 1), date(2026, 7, 1))],
            "user_id bigint, category_id int, limit_amount decimal(18,2), currency string, period_start date, period_end date",
        )
        spend = b.budget_spend(limits, demo, matrix, "month", date(2026, 6, 1))
        facts = [x for x in exchanged_before_aggregation(spend) if "amount" in x and "occurred_on" in x]
        assert not facts
        [row] = spend.collect()
        expected = fx.convert(
            demo.filter("category_id = 4 and occurred_on >= '2026-06-01'"), matrix, "amount", "currency", "EUR"
        ).agg(F.sum("amt")).first()[0]
        assert row.spent == expected
        own = fx.to_display(demo, matrix, users=users)
        funds = b.carry_over_funds(users, own, ["month"], date(2026, 6, 1))
        assert {r.user_id: r.amount for r in funds.collect()} == {1: dec("2530.00"), 2: dec("0.00")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_missing_rate_is_an_error_only_where_it_is_needed(spark, demo, users, matrix):
    odd = demo.withColumn("currency", F.when(F.col("id") == 1, "JPY").otherwise(F.col("currency")))
    yen = spark.createDataFrame([(1, "one", "JPY", "US"), (2, "two", "EUR", "EU")], users.schema)
    own = fx.to_display(odd, matrix, users=yen)
    try:
        own.groupBy("user_id").agg(F.sum("amt")).collect()
        raise AssertionError("no error")
    except Exception as error:
        assert "no exchange rate" in str(error)
    other = fx.to_display(odd.filter("id = 1"), matrix, users=yen)
    assert other.agg(F.sum("amt").alias("s")).first().s == dec("4590.00")


def test_active_salary_with_ties_and_missing_times(spark):
    at = date(2026, 1, 1)
    rows = [(1, 1, True, at, "a"), (2, 1, True, at, "b"), (3, 1, False, date(2026, 2, 1), "c"),
            (4, 2, True, None, "d"), (5, 2, True, None, "e")]
    profiles = spark.createDataFrame(rows, "id bigint, user_id bigint, is_active boolean, updated_at date, note string")
    assert sorted((r.user_id, r.id, r.note) for r in active_salary(profiles).collect()) == [(1, 2, "b"), (2, 5, "e")]


def test_users_without_rows_have_an_empty_list(spark, demo, users, categories, matrix):
    profiles = spark.createDataFrame(
        [], "id bigint, user_id bigint, currency string, is_active boolean, updated_at date, breakdown string"
    )
    found = dashboards.dashboard(users, demo, categories, profiles, matrix, "USD")
    lists = {r.user_id: r.top_expense_categories for r in found.collect()}
    assert lists[2] == [] and len(lists[1]) == 5
