from datetime import date

import pytest
from pyspark.sql import functions as F

from purseflow.operators import ledger as l
from purseflow.schemas import TABLES
from purseflow.session import shared_folder
from purseflow.sources import csv_export, seeds, tables


@pytest.fixture(scope="module")
def stored(spark, demo, categories, demo_budgets, users, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ledger"))
    frames = {
        "transactions": demo.withColumn("direction", F.upper("direction")),
        "categories": categories.withColumn("direction", F.upper("direction")),
        "budgets": demo_budgets,
        "users": users,
    }
    for name, schema in TABLES.items():
        tables.write_table(frames.get(name, spark.createDataFrame([], schema)), root, name)
    return root


def test_tables_round_trip_with_fixed_schemas(spark, stored, demo):
    read = tables.read_ledger(spark, stored)
    assert set(read) == set(TABLES)
    tx = read["transactions"]
    assert {r.direction for r in tx.collect()} == {"inbound", "outbound"}
    assert dict(tx.dtypes)["amount"] == "decimal(14,2)"
    columns = demo.columns
    assert sorted(map(tuple, tx.select(columns).collect())) == sorted(map(tuple, demo.collect()))
    counts = {r[0]: r[1] for r in tables.table_counts(read).collect()}
    assert counts["transactions"] == 12 and counts["budgets"] == 3 and counts["jurisdictions"] == 0


def test_date_filters_skip_months_and_columns(spark, stored):
    tx = tables.read_table(spark, stored, "transactions")
    june = l.filter_transactions(tx, date(2026, 6, 1), date(2026, 6, 30), direction="outbound")
    plan = june.select("id", "amount")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert "GreaterThanOrEqual(occurred_on" in plan
    schema = plan.split("ReadSchema: ")[1]
    assert "description" not in schema and "currency" not in schema
    assert len(june.inputFiles()) >= 1 and june.count() == 6


@pytest.mark.parametrize("fmt", ["csv", "json", "orc"])
def test_other_formats(spark, demo, tmp_path, fmt):
    tables.write_table(demo, str(tmp_path), "transactions", fmt)
    back = tables.read_table(spark, str(tmp_path), "transactions", fmt)
    assert back.agg(F.sum("amount")).first()[0] == demo.agg(F.sum("amount")).first()[0]
    assert back.select("occurred_on").distinct().count() == 12


def test_expense_export(spark, demo, categories, matrix, tmp_path):
    path = str(tmp_path / "out")
    csv_export.export_expenses(demo, categories, path, matrix, "php", start="2026-06-01")
    files = [p for p in (tmp_path / "out").iterdir() if p.suffix == ".csv"]
    lines = [line for p in sorted(files) for line in p.read_text().splitlines()]
    assert lines[0] == "user_id,date,category,direction,amount,currency,region,description,amount_PHP"
    assert "1,2026-06-04,Groceries,outbound,480.00,USD,US,,27840.00" in lines
    assert len([x for x in lines if x.startswith("1,")]) == 6
    per_user = str(tmp_path / "per-user")
    csv_export.export_expenses(demo, categories, per_user, per_user_folders=True)
    assert (tmp_path / "per-user" / "user_id=1").is_dir()


def test_fx_export(spark, tmp_path):
    rows = [("USD", "PHP", date(2026, 7, 1), "58.5"), ("EUR", "PHP", date(2026, 7, 1), "63")]
    kind = "base_currency string, quote_currency string, as_of date, rate string"
    history = spark.createDataFrame(rows, kind).withColumn("rate", F.col("rate").cast("decimal(18,8)"))
    csv_export.export_fx_history(history, "usd", str(tmp_path / "fx"))
    text = "".join(p.read_text() for p in (tmp_path / "fx").glob("*.csv"))
    assert text.splitlines() == ["date,base_currency,quote_currency,rate", "2026-07-01,USD,PHP,58.500000"]


def test_seeds_leave_existing_rows_alone(spark):
    kind = "id int, name string, direction string, statutory boolean, region string, is_system boolean, user_id bigint"
    table = spark.createDataFrame([(7, "Groceries", "outbound", False, None, False, 1)], kind)
    once = seeds.seed_categories(table)
    assert once.count() == 41 and once.select("id").distinct().count() == 41
    assert once.filter("name = 'Groceries'").first().user_id == 1
    assert once.filter("statutory").count() == 14
    assert seeds.seed_categories(once).count() == 41
    rates = seeds.seed_rates(
        spark.createDataFrame([], "base_currency string, quote_currency string, rate decimal(18,8), as_of date"),
        date(2026, 1, 1),
    )
    assert {r.quote_currency: float(r.rate) for r in rates.collect()} == {"PHP": 58, "AUD": 1.52, "EUR": 0.92}
    assert seeds.seed_rates(rates, date(2026, 2, 1)).count() == 3
    empty = spark.createDataFrame(
        [], "region string, name string, currency string, modelled_as string, supported boolean"
    )
    assert seeds.seed_jurisdictions(empty).count() == 4


def test_the_shared_folder_is_the_sessions(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
