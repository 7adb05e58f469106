"""Batches against the same operations applied one by one in plain Python."""

from datetime import date, datetime, timedelta
from decimal import Decimal
from random import Random

import pytest
from pyspark.sql import functions as F

from conftest import BUDGETS, CATEGORIES, TX, dec
from purseflow.operators import changes as c

DAY = date(2026, 6, 1)
CHANGE = f"seq bigint, op string, fields array<string>, description string, {TX}"
REGION = {"US": "USD", "AU": "AUD"}


def random_changes(random: Random, n: int):
    """Inserts, patches and deletes that hit the same few rows again and again."""
    rows = []
    for seq in range(1, n + 1):
        op = random.choice(["insert", "patch", "patch", "patch", "delete"])
        key = 1000 + seq if op == "insert" else random.choice([*range(1, 9), *range(1001, 1001 + n)])
        fields = random.sample(c.PATCHABLE, random.randint(0, 3)) if op == "patch" else []
        rows.append(
            (
                seq,
                op,
                fields,
                random.choice([None, "note"]),
                key,
                random.choice([1, 1, 1, 2]),
                random.choice(["inbound", "outbound"]),
                random.choice([1, 4, 5, 99]),
                Decimal(random.randint(-5, 500)),
                random.choice([None, "", "eur", "USD"]),
                random.choice([None, "US", "AU"]),
                DAY + timedelta(days=random.randint(0, 9)),
                random.choice([None, "10:00:00"]),
            )
        )
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_transactions(spark, users, categories, seed):
    base = [
        (i, 1 if i % 4 else 2, "outbound", 4, dec(10 * i), "USD", "US", DAY, None, None)
        for i in range(1, 9)
    ]
    batch = random_changes(Random(seed), 120)
    table = spark.createDataFrame(base, TX + ", description string")
    names = table.columns
    sides, bases = {1: "inbound", 4: "outbound", 5: "outbound"}, {1: "USD", 2: "EUR"}

    state = {row[0]: dict(zip(names, row)) for row in base}
    refused = set()
    for seq, op, fields, note, *cells in batch:
        row = dict(zip(names, [*cells, note]))
        if op == "insert":
            if row["amount"] <= 0 or sides.get(row["category_id"]) != row["direction"]:
                refused.add(seq)
                continue
            row["currency"] = (
                (row["currency"] or "").upper() or REGION.get(row["region"]) or bases[row["user_id"]]
            )
            state[row["id"]] = row
        elif row["id"] not in state or state[row["id"]]["user_id"] != row["user_id"]:
            refused.add(seq)
        elif op == "delete":
            del state[row["id"]]
        else:
            for field in fields:
                value = row[field]
                if field == "currency" and value is not None:
                    value = value.upper()
                state[row["id"]][field] = value

    out, rejected = c.apply_transactions(
        table, spark.createDataFrame(batch, CHANGE).repartition(3), categories, users
    )
    assert {r.id: r.asDict() for r in out.collect()} == state
    assert {r.seq for r in rejected.collect()} == refused


@pytest.mark.parametrize("seed", [1, 2])
def test_budgets(spark, users, categories, seed):
    random = Random(seed)
    base = {(u, 4, 2026, mth): (dec(100), "USD") for u in (1, 2) for mth in range(1, 4)}
    state, refused, batch = dict(base), set(), []
    for seq in range(1, 101):
        op = random.choice(["upsert", "delete"])
        user, category, month = random.choice([1, 2]), random.choice([4, 4, 4, 1, 99]), random.randint(0, 6)
        limit, currency = Decimal(random.randint(-1, 9)), random.choice([None, "php"])
        batch.append((seq, op, user, category, 2026, month, limit, currency))
        key = (user, category, 2026, month)
        if op == "delete":
            if state.pop(key, None) is None:
                refused.add(seq)
        elif limit <= 0 or month == 0 or category != 4:
            refused.add(seq)
        else:
            state[key] = (limit, currency.upper() if currency else {1: "USD", 2: "EUR"}[user])
    table = spark.createDataFrame([(*k, *v) for k, v in base.items()], BUDGETS)
    changes = spark.createDataFrame(batch, f"seq bigint, op string, {BUDGETS}")
    out, rejected = c.apply_budgets(table, changes, categories, users)
    assert {tuple(r[:4]): tuple(r[4:]) for r in out.collect()} == state
    assert {r.seq for r in rejected.collect()} == refused


def test_fund_overrides(spark, users):
    kind = "user_id bigint, scope string, period_start date, amount decimal(14,2), currency string"
    table = spark.createDataFrame([(1, "month", DAY, dec(5), "USD"), (2, "all", DAY, dec(6), "USD")], kind)
    batch = [
        (1, "upsert", 1, "ytd", DAY, dec(500), "USD"),
        (2, "upsert", 1, "ytd", DAY, dec(750), None),
        (3, "reset", 2, "all", DAY, None, None),
        (4, "reset", 2, "3m", DAY, None, None),
    ]
    changes = spark.createDataFrame(batch, f"seq bigint, op string, {kind}")
    found = {(r.user_id, r.scope): r.amount for r in c.apply_fund_overrides(table, changes, users).collect()}
    assert found == {(1, "month"): 5, (1, "ytd"): 750}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_profiles(spark, seed):
    random = Random(seed)
    start = datetime(2026, 1, 1)
    base = {i: [i % 3 + 1, i <= 3, start] for i in range(1, 10)}  # one active profile per user
    state = {k: list(v) for k, v in base.items()}
    created, actions, refused = [], [], set()

    def activate(key, at):
        for other, row in state.items():
            on = other == key
            if row[0] == state[key][0] and row[1] != on:
                row[1], row[2] = on, at

    for seq in range(1, 61):
        at = start + timedelta(hours=seq)
        op = random.choice(["create", "activate", "activate", "delete"])
        user = random.randint(1, 3)
        if op == "create":
            wished, key = random.random() < 0.5, 100 + seq
            created.append((seq, key, user, wished, at))
            state[key] = [user, False, at]
            if wished:
                activate(key, at)
            continue
        key = random.choice([*range(1, 10), *range(101, 161)])
        actions.append((seq, op, key, user, at))
        if key not in state or state[key][0] != user:
            refused.add(seq)
        elif op == "delete":
            del state[key]
        else:
            activate(key, at)
    kind = "id bigint, user_id bigint, is_active boolean, updated_at timestamp_ntz"
    table = spark.createDataFrame([(k, *v) for k, v in base.items()], kind)
    new = spark.createDataFrame(created, f"seq bigint, {kind}")
    asked = spark.createDataFrame(
        actions, "seq bigint, op string, id bigint, user_id bigint, at timestamp_ntz"
    )
    out, rejected = c.apply_profiles(table, new, asked)
    assert {r.id: [r.user_id, r.is_active, r.updated_at] for r in out.collect()} == state
    assert {r.seq for r in rejected.collect()} == refused


def test_categories(spark):
    table = spark.createDataFrame(
        [(1, "Dining", "outbound", False, None, True, None)],
        f"{CATEGORIES}, region string, is_system boolean, user_id bigint",
    )
    batch = [
        (1, 10, "Pets", "outbound", 1),
        (2, 11, "Pets", "outbound", 2),
        (3, 12, "Pets", "inbound", 2),
        (4, 13, "Dining", "outbound", 1),
    ]
    changes = spark.createDataFrame(
        batch, "seq bigint, id int, name string, direction string, user_id bigint"
    )
    out, rejected = c.add_categories(table, changes)
    added = {r.id: (r.user_id, r.statutory, r.is_system) for r in out.filter("id >= 10").collect()}
    assert added == {10: (1, False, False), 12: (2, False, False)}
    assert {r.seq for r in rejected.collect()} == {2, 4}


def test_users(spark, users):
    table = users.withColumn("email", F.lit("a@b.c"))
    kind = "seq bigint, id bigint, fields array<string>, name string, email string, base_currency string, default_region string"
    batch = [
        (1, 1, ["name"], "first", None, None, None),
        (2, 1, ["name", "email"], "second", None, "PHP", None),
        (3, 7, ["name"], "nobody", None, None, None),
    ]
    out, rejected = c.update_users(table, spark.createDataFrame(batch, kind))
    row = out.filter("id = 1").first()
    assert (row.name, row.email, row.base_currency) == ("second", None, "USD")
    assert [r.seq for r in rejected.collect()] == [3]
    assert c.default_user_if_none(table).count() == 2
    (only,) = c.default_user_if_none(table.limit(0)).collect()
    assert (only.id, only.base_currency) == (1, "USD")


def test_small_batches_leave_the_table_unshuffled(spark, users, categories, tmp_path):
    rows = spark.range(20000).select(
        "id",
        F.lit(1).cast("bigint").alias("user_id"),
        F.lit("outbound").alias("direction"),
        F.lit(4).alias("category_id"),
        F.lit(dec(1)).cast("decimal(14,2)").alias("amount"),
        F.lit("USD").alias("currency"),
        F.lit("US").alias("region"),
        F.lit(DAY).alias("occurred_on"),
        F.lit(None).cast("string").alias("occurred_time"),
        F.lit(None).cast("string").alias("description"),
    )
    rows.write.parquet(str(tmp_path / "tx"))
    table = spark.read.parquet(str(tmp_path / "tx"))
    batch = [(1, "patch", ["amount"], None, 5, 1, "outbound", 4, dec(9), None, None, DAY, None)]
    out, _ = c.apply_transactions(table, spark.createDataFrame(batch, CHANGE), categories, users)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert out.filter("amount = 9").count() == 1 and out.count() == 20000
