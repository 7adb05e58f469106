"""Balances kept by month against full recomputation."""

from datetime import date, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from conftest import TX
from purseflow.operators import balances, ledger as l, reports as r
from purseflow.session import staged
from purseflow.sources import tables, versions
from test_changes import CHANGE
from test_versions import START, edit, plain, some_rows


def usd(df):
    """All rows of these tables are in USD."""
    return df.withColumn("amt", F.col("amount").cast("decimal(18,2)"))


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(some_rows(300, days=1200), TX + ", description string")


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_keep_nets_up_to_date(spark, users, categories, tmp_path, table, seed):
    """After every batch the nets equal those of the new version; only rewritten months are read."""
    random = Random(seed)
    root = str(tmp_path / "table")
    versions.create_versions(table, root)
    nets = staged(balances.month_nets(usd(table)), "nets")
    for step in range(2):
        batch = []
        for seq in range(1, 12):
            op = random.choice(["insert", "patch", "delete"])
            key = 5000 + seq + 100 * step if op == "insert" else random.randrange(1, 300)
            day = START + timedelta(random.randrange(1300))
            batch.append(edit(seq, op, key, 1 + key % 2, ["amount", "occurred_on"], day, "12.34"))
        changes = spark.createDataFrame(batch, CHANGE)
        before, after, _ = versions.apply_batch(spark, root, changes, categories, users)
        months = versions.changed_months(before, after)
        old, new = (versions.rows_of(spark, root, v) for v in (before, after))
        touched = [versions.in_months(x, months) for x in (old, new)]
        for part in touched:
            plan = part._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [month" in plan
        nets = staged(balances.updated_nets(nets, balances.net_differences(*map(usd, touched))), "nets")
        assert plain(nets) == plain(balances.month_nets(usd(new)))
    kept, full = balances.month_balances(nets), r.running_balance(usd(new))
    ends = full.groupBy("user_id", F.trunc("occurred_on", "month").alias("month")).agg(
        F.max_by("balance", "occurred_on").alias("closing")
    )
    columns = ("user_id", "month", "closing")
    assert rows_of(kept, *columns) == rows_of(ends, *columns)


def test_reports_from_kept_balances(spark, table):
    converted = usd(table)
    nets = balances.month_nets(converted)
    start, end = date(2021, 2, 10), date(2021, 7, 4)
    inside = F.col("occurred_on").between(start, end)
    found = balances.running_balance_kept(nets, converted, start, end)
    columns = ("user_id", "occurred_on", "income", "expense", "net", "balance")
    assert rows_of(found, *columns) == rows_of(r.running_balance(converted).filter(inside), *columns)
    each = balances.transaction_balance_kept(nets, converted, start, end)
    whole = l.running_balance_by_transaction(converted).filter(inside)
    assert rows_of(each, "id", "balance") == rows_of(whole, "id", "balance")
    for day in (start, end, date(2019, 1, 1), date(2040, 1, 1)):
        at = {x.user_id: x.balance for x in balances.balance_at_kept(nets, converted, day).collect()}
        expected = {x.user_id: x.balance for x in r.balance_at(converted, day).collect()}
        assert {k: v for k, v in at.items() if v} == {k: v for k, v in expected.items() if v}


def test_stored_months_outside_the_range_are_not_read(spark, table, tmp_path):
    tables.write_table(table, str(tmp_path), "transactions")
    stored = tables.read_table(spark, str(tmp_path), "transactions")
    nets = staged(balances.month_nets(usd(table)), "nets")
    for report in (balances.running_balance_kept, balances.transaction_balance_kept):
        found = report(nets, usd(stored), date(2021, 2, 10), date(2021, 4, 4))
        plan = found._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.split("\n") if "Scan parquet" in x and str(tmp_path) in x]
        assert scans and all("PartitionFilters: [isnotnull(month" in x for x in scans)


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_newest_rows_from_few_months(spark, table, tmp_path, limit):
    tables.write_table(table, str(tmp_path), "transactions")
    stored = tables.read_table(spark, str(tmp_path), "transactions")
    nets = staged(balances.month_nets(usd(table)), "nets")
    found = balances.newest_transactions(nets, stored, limit)
    columns = ("user_id", "position", "id")
    assert rows_of(found, *columns) == rows_of(l.list_transactions(table, limit), *columns)
    one = spark.createDataFrame([(1,)], "user_id bigint")
    mine = balances.newest_transactions(nets, stored, limit, one)
    assert rows_of(mine, *columns) == rows_of(l.list_transactions(table.filter("user_id = 1"), limit), *columns)
    months = balances.months_of_newest(nets, 7, one).count()
    assert months <= 3
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_empty_and_undated_rows(spark, table):
    none = usd(table.limit(0))
    nets = balances.month_nets(none)
    assert nets.count() == balances.month_balances(nets).count() == 0
    undated = usd(table.withColumn("occurred_on", F.lit(None).cast("date")))
    assert balances.month_nets(undated).count() == 0
    same = balances.net_differences(usd(table), usd(table))
    assert same.count() == 0 and plain(balances.updated_nets(balances.month_nets(usd(table)), same)) == plain(
        balances.month_nets(usd(table))
    )
    with pytest.raises(ValueError):
        balances.months_of_newest(nets, 0)
