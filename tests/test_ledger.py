from datetime import date, timedelta
from decimal import Decimal
from random import Random

import pytest
from pyspark.sql import functions as F

from conftest import TX, dec, transactions
from purseflow.operators import fx, ledger as l, skew
from purseflow.operators.ledger import oldest_first


def in_usd(df, matrix):
    return fx.to_display(df, matrix, "USD")


@pytest.fixture(scope="module")
def busy(spark):
    """One user holds most rows, many on one day without a time."""
    random = Random(7)
    rows = []
    for key in range(1, 1501):
        user = 1 if random.random() < 0.7 else random.randint(2, 30)
        day = date(2026, 1, 1) + timedelta(days=0 if random.random() < 0.5 else random.randint(0, 40))
        time = None if random.random() < 0.5 else f"{random.randint(0, 23):02d}:00:00"
        category = random.randint(1, 8)
        rows.append((key, user, category, Decimal(random.randint(1, 99999)) / 100, day, time))
    return transactions(spark, rows)


def by_hand(rows):
    """Running balance by plain sorting."""
    balances, running = {}, {}
    ordered = sorted(rows, key=lambda r: (r.occurred_on, r.occurred_time or "00:00:00", r.id))
    for r in ordered:
        step = r.amount if r.direction == "inbound" else -r.amount
        running[r.user_id] = running.get(r.user_id, Decimal(0)) + step
        balances[r.id] = running[r.user_id]
    return balances


def test_running_balance(busy, matrix):
    out = l.running_balance_by_transaction(in_usd(busy, matrix))
    found = {r.id: r.balance for r in out.select("id", "balance").collect()}
    assert found == by_hand(busy.collect())


def test_hot_user_spreads_over_days(spark, matrix):
    """Nine rows in ten belong to one user; no partition holds more than a share of them."""
    rng = Random(4)
    rows = [
        (k, 1 if rng.random() < 0.9 else 2 + k % 40, 4, Decimal(rng.randint(1, 999)),
         date(2026, 1, 1) + timedelta(days=rng.randrange(120)), None)
        for k in range(4000)
    ]
    tx = transactions(spark, rows)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = l.running_balance_by_transaction(in_usd(tx, matrix))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        found = {r.id: r.balance for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name, value in kept.items():
            spark.conf.set(name, value)
    assert found == by_hand(tx.collect())
    assert len(sizes) == 16 and max(sizes) < 3 * 4000 / 16


def test_no_job_runs_while_planning(busy, matrix):
    converted = in_usd(busy, matrix)
    tracker = busy.sparkSession.sparkContext.statusTracker()
    names = busy.selectExpr("category_id id", "'c' name").limit(0)
    # Dimensions are counted once per table; the rows themselves are not looked at.
    assert skew.is_small(names)
    busy.sparkSession.sparkContext.setJobGroup("planning", "")
    l.ledger_view(converted, names)
    assert not tracker.getJobIdsForGroup("planning")


def test_previous_value(busy):
    out = skew.previous_value(busy, "user_id", oldest_first(), "category_id", "before")
    found = {r.id: r.before for r in out.collect()}
    last, expected = {}, {}
    for r in sorted(busy.collect(), key=lambda r: (r.occurred_on, r.occurred_time or "00:00:00", r.id)):
        expected[r.id] = last.get(r.user_id)
        last[r.user_id] = r.category_id
    assert found == expected


def test_listing_is_newest_first_with_unknown_times_last(spark):
    day = date(2026, 6, 1)
    rows = [(1, 1, 4, 1, day, None), (2, 1, 4, 1, day, "00:00:00"), (3, 1, 4, 1, day, "09:00:00"),
            (4, 1, 4, 1, date(2026, 5, 1), "10:00:00"), (5, 2, 4, 1, day, None)]
    listed = l.list_transactions(transactions(spark, rows), limit=3).orderBy("user_id", "position")
    assert [(r.user_id, r.id) for r in listed.collect()] == [(1, 3), (1, 2), (1, 1), (2, 5)]
    with pytest.raises(ValueError):
        l.list_transactions(transactions(spark, rows), limit=0)


def test_long_listing_goes_through_the_salted_pass(busy):
    short = l.list_transactions(busy, limit=2000)
    assert "_salt" in short._jdf.queryExecution().analyzed().toString()
    assert short.count() == busy.count()
    ranks = short.filter("user_id = 1").agg(F.max("position"), F.countDistinct("position")).first()
    assert ranks[0] == ranks[1]


def test_only_counted_small_tables_are_marked_for_broadcast(spark):
    dimension = spark.range(50).withColumnRenamed("id", "category_id")
    small, large = skew.pinned(dimension, max_rows=50), skew.pinned(dimension, max_rows=49)
    assert "ResolvedHint" in small._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in large._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("share", [0.5, 0.01])
def test_lookup_join_matches_a_plain_join(spark, how, share):
    """Frequent, rare, null and unknown keys; one key and two; small and large lookups."""
    rows = [(i, 1 if i % 2 else i % 50, "x" if i % 3 else "y") for i in range(600)]
    rows += [(1000, None, "x"), (1001, 5, None), (1002, 777, "x")]
    facts = spark.createDataFrame(rows, "id bigint, a int, b string")
    sides = spark.createDataFrame([(a, b, a * 10, a < 3) for a in range(60) for b in "xy"], "a int, b string, c int, s boolean")
    one = sides.filter("b = 'x'").drop("b")
    for lookup, keys in ((one, ["a"]), (sides, ["a", "b"])):
        expected = sorted(map(tuple, facts.join(lookup, keys, how).collect()), key=repr)
        for most in (None, 0):
            for common in (None, F.col("s")):
                found = skew.lookup_join(facts, lookup, keys, how, max_rows=most, common=common, share=share)
                assert sorted(map(tuple, found.collect()), key=repr) == expected
    with pytest.raises(ValueError):
        skew.lookup_join(facts, one, ["a"], "full")


def test_lookup_join_evens_out_two_hot_categories(spark):
    """Two categories hold 90 % of the rows and the lookup is too large: no task has twice the median."""
    rows = spark.range(40_000).withColumn(
        "category_id", F.expr("case when id % 10 < 5 then 1 when id % 10 < 9 then 2 else id % 3001 end")
    )
    names = spark.range(4000).select(F.col("id").alias("category_id"), F.lit("n").alias("name"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        spread = rows.repartition(8)
        joined = skew.lookup_join(spread, names, ["category_id"], max_rows=0)
        even = joined.groupBy(F.spark_partition_id().alias("p")).count()
        found = sorted(r["count"] for r in even.collect())
        assert found[-1] <= 2 * found[len(found) // 2]
        assert joined.count() == 40_000 and joined.filter("name is null").count() == 0
        plain = rows.join(names, "category_id").groupBy(F.spark_partition_id().alias("p")).count()
        uneven = sorted(r["count"] for r in plain.collect())
        assert uneven[-1] > 4 * uneven[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_frequent_hashes_hold_every_frequent_key(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 4 == 0, 7).otherwise(F.col("id")).alias("k"))
    seven = rows.filter("k = 7").select(F.xxhash64("k")).first()[0]
    found = skew.frequent_hashes(rows, ["k"], 0.1)
    assert seven in found and len(found) <= 10
    assert skew.frequent_hashes(rows.limit(0), ["k"]) == []


def test_filters(spark, demo):
    assert l.filter_transactions(demo, "2026-06-01", "2026-06-06").count() == 4
    nowhere = demo.withColumn("region", F.lit(None).cast("string"))
    assert l.filter_transactions(nowhere, region="US").count() == 0
    assert l.filter_transactions(demo, direction="inbound").count() == 3


def test_ledger_view_keeps_full_history_balances(demo, categories, matrix):
    view = l.ledger_view(in_usd(demo, matrix), categories, limit=2, start="2026-06-01")
    rows = view.orderBy("position").collect()
    assert [(r.id, r.category_name, r.balance) for r in rows] == [
        (12, "Utilities", dec("5125.00")),
        (11, "Subscriptions", dec("5305.00")),
    ]


def test_expense_deltas(demo):
    rows = l.expense_deltas(demo, n=3).orderBy("id").collect()
    assert [(r.id, r.delta) for r in rows] == [(10, None), (11, dec("-105.00")), (12, dec("125.00"))]


def test_names_and_currencies(spark, demo, categories):
    stray = demo.withColumn("category_id", F.lit(99))
    assert l.with_category_name(stray, categories).first().category_name == "Uncategorized"
    cases = spark.createDataFrame(
        [("eur", "US"), ("", "AU"), (None, "PH"), (None, None)], "given string, region string"
    )
    code = l.write_currency(F.col("given"), F.col("region"), F.lit("USD"))
    assert [r[0] for r in cases.select(code).collect()] == ["EUR", "AUD", "PHP", "USD"]


def test_rejects(spark, categories):
    rows = [
        (1, 1, "outbound", 4, dec(5), "USD", None, date(2026, 6, 1), None),
        (2, 1, "inbound", 4, dec(5), "USD", None, date(2026, 6, 1), None),
        (3, 1, "outbound", 99, dec(5), "USD", None, date(2026, 6, 1), None),
        (4, 1, "outbound", 4, dec(0), "USD", None, date(2026, 6, 1), None),
    ]
    found = l.direction_rejects(spark.createDataFrame(rows, TX), categories)
    assert {r.id: r.reason for r in found.collect()} == {
        2: "direction mismatch",
        3: "category not found",
        4: "amount must be positive",
    }


@pytest.mark.parametrize("filters", [{}, {"direction": "outbound"}, {"end": date(2026, 1, 9)}])
def test_ledger_view_reaches_back_as_far_as_it_lists(busy, matrix, filters):
    """The newest rows and their balances, as taken from the whole history."""
    names = busy.selectExpr("category_id id", "'c' name").limit(0)
    view = l.ledger_view(in_usd(busy, matrix), names, limit=4, **filters)
    balances = by_hand(busy.collect())
    rows = l.filter_transactions(busy, **filters).collect()
    newest = sorted(rows, key=lambda r: (r.occurred_on, r.occurred_time or "", r.id), reverse=True)
    expected, taken = {}, {}
    for r in newest:
        taken[r.user_id] = taken.get(r.user_id, 0) + 1
        if taken[r.user_id] <= 4:
            expected[r.id] = (taken[r.user_id], balances[r.id])
    assert {r.id: (r.position, r.balance) for r in view.collect()} == expected
