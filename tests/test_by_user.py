"""Tables in buckets of the user, and reports out of one rollup."""

import pytest
from pyspark.sql import functions as F

from purseflow.operators import fx, reports as r, rollup, skew
from purseflow.operators.ledger import filter_transactions
from purseflow.sources import by_user


@pytest.fixture(scope="module")
def crowd(spark):
    """Sixty users with a few rows each, and one with half of all rows."""
    codes = F.array(*[F.lit(c) for c in ("USD", "EUR", "PHP", "AUD")])
    pick = lambda n: F.element_at(codes, (n % 4 + 1).cast("int"))
    users = spark.range(1, 62).select(
        "id", F.lit("n").alias("name"), pick(F.col("id")).alias("base_currency"), F.lit("US").alias("default_region")
    )
    tx = spark.range(1200).select(
        "id",
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 63).cast("bigint").alias("user_id"),
        F.when(F.col("id") % 5 == 0, "inbound").otherwise("outbound").alias("direction"),
        (F.col("id") % 9).cast("int").alias("category_id"),
        (F.col("id") / 7).cast("decimal(14,2)").alias("amount"),
        pick(F.col("id") * 7).alias("currency"),
        F.lit("US").alias("region"),
        F.date_add(F.lit("2026-01-01"), (F.col("id") % 200).cast("int")).alias("occurred_on"),
        F.lit(None).cast("string").alias("occurred_time"),
    )
    return users, tx


def amounts(df):
    return sorted(map(tuple, df.select("id", "user_id", "display_currency", "amt").collect()))


def test_bucketed_conversion_equals_the_plain_one(spark, crowd, matrix, tmp_path):
    users, tx = crowd
    stored = by_user.save_by_user(spark, users, tx, 4, str(tmp_path / "t"), share=0.2)
    seven = spark.range(7, 8).select(F.xxhash64("id")).first()[0]
    assert seven in stored.hot_hashes and stored.hot.count() == tx.filter("user_id = 7").count() >= 600
    assert stored.light.filter("user_id = 7").count() == 0
    assert stored.transactions().count() == tx.count()
    plain = fx.to_display(tx, matrix, users=users)
    assert amounts(by_user.base_amounts(stored, matrix)) == amounts(plain)
    even = by_user.save_by_user(spark, users, tx.filter("user_id <> 7"), 4, str(tmp_path / "u"), share=0.2)
    assert amounts(by_user.base_amounts(even, matrix)) == amounts(plain.filter("user_id <> 7"))


def test_no_transaction_is_exchanged(spark, crowd, matrix, tmp_path):
    """Only sums travel, also where no side may be broadcast; months are pruned."""
    users, tx = crowd
    stored = by_user.save_by_user(spark, users, tx, 4, str(tmp_path / "t"), share=0.2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        converted = by_user.base_amounts(stored, matrix)
        plan = converted._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(user_id" not in plan and "SortMergeJoin" in plan
        march = filter_transactions(converted, "2026-03-01", "2026-03-31")
        plan = march._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(month" in plan
        plain = fx.to_display(tx, matrix, users=users)
        sums = lambda df: sorted(map(tuple, r.totals(df).collect()))
        assert sums(converted) == sums(plain)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reports_of_the_rollup_equal_those_of_the_rows(crowd, categories, matrix):
    users, tx = crowd
    rows = fx.to_display(tx, matrix, "EUR")
    daily = rollup.daily_rollup(rows)
    monthly = rollup.monthly_rollup(daily)
    assert daily.agg(F.sum("entries")).first()[0] == monthly.agg(F.sum("entries")).first()[0] == 1200
    assert monthly.count() < daily.count() <= 1200
    same = lambda a, b: sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    for report in (
        r.totals,
        lambda x: r.per_category_totals(x, categories),
        lambda x: r.monthly_totals(x, 4),
        lambda x: r.monthly_expense_by_category(x, categories, 5),
        lambda x: r.statutory_split(r.per_category_totals(x, categories), categories),
    ):
        assert same(report(rows), report(daily)) and same(report(rows), report(monthly))
    for report in (
        r.daily_totals,
        lambda x: r.running_balance(x, "2026-02-03", "2026-05-05"),
        lambda x: r.balance_at(x, "2026-04-17"),
        lambda x: r.last_balances(users, x, "2026-02-03", "2026-03-03"),
    ):
        assert same(report(rows), report(daily))


def test_rollups_are_dealt_by_rows(crowd, matrix, monkeypatch):
    # 1200 rows are a few KB, which Spark would merge into one task, and so into one file.
    _, tx = crowd
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 60)
    rows = fx.to_display(tx, matrix, "EUR")
    daily = rollup.daily_rollup(rows)
    monthly = rollup.monthly_rollup(daily)
    per_file = lambda df: [x["count"] for x in df.groupBy(F.input_file_name()).count().collect()]
    for df in (daily, monthly):
        assert len(per_file(df)) >= 8 and max(per_file(df)) < 200
    plain = rows.groupBy("user_id", "category_id", "direction").agg(F.sum("amt"), F.min("id"), F.count("id"))
    summed = lambda df: df.groupBy("user_id", "category_id", "direction").agg(F.sum("amt"), F.min("id"), F.sum("entries"))
    found = lambda df: sorted(map(tuple, df.collect()))
    assert found(summed(daily)) == found(summed(monthly)) == found(plain)


def test_empty_tables(spark, crowd, matrix, categories, tmp_path):
    users, tx = crowd
    stored = by_user.save_by_user(spark, users.limit(0), tx.limit(0), 2, str(tmp_path / "e"))
    assert by_user.base_amounts(stored, matrix).count() == 0 and stored.hot_hashes == ()
    assert rollup.monthly_rollup(rollup.daily_rollup(fx.to_display(tx.limit(0), matrix, "USD"))).count() == 0
