import json
from datetime import date
from decimal import ROUND_CEILING, ROUND_HALF_UP, Decimal, getcontext

import pytest
from pyspark.sql import functions as F

from conftest import dec
from purseflow.operators import fx
from purseflow.sources import fx_payloads

RATES = "base_currency string, quote_currency string, rate decimal(18,8)"
HISTORY = RATES + ", as_of date"


def pairs(spark, *rows):
    table = spark.createDataFrame([(a, b, dec(r)) for a, b, r in rows], RATES)
    return {(r[0], r[1]): r[2] for r in fx.rate_matrix(table).collect()}


def test_matrix_routes(spark):
    found = pairs(spark, ("USD", "PHP", 58), ("USD", "AUD", "1.52"), ("EUR", "USD", "1.25"))
    assert len(found) == 16
    getcontext().prec = 50
    expected = {
        ("PHP", "USD"): 1 / Decimal(58),
        ("PHP", "AUD"): Decimal("1.52") / 58,
        ("EUR", "PHP"): Decimal("1.25") * 58,
        ("PHP", "EUR"): 1 / (58 * Decimal("1.25")),
        ("USD", "USD"): Decimal(1),
    }
    for pair, rate in expected.items():
        assert found[pair] == rate.quantize(Decimal("1e-16"), ROUND_CEILING), pair


def test_direct_rate_wins_and_zero_has_no_inverse(spark):
    found = pairs(spark, ("USD", "PHP", 58), ("PHP", "USD", "0.02"), ("USD", "XXX", 0))
    assert found[("USD", "PHP")] == 58 and found[("PHP", "USD")] == dec("0.02")
    assert ("XXX", "USD") not in found and found[("USD", "XXX")] == 0
    assert len([1 for pair in found if pair == ("PHP", "PHP")]) == 1


def test_conversion_is_exact_half_up(spark, matrix):
    """Every cent amount up to 500.00, all pairs, against exact fractions."""
    units = {"USD": Decimal(1), "PHP": Decimal(58), "AUD": Decimal("1.52"), "EUR": Decimal("0.92")}
    codes = F.array(*[F.lit(c) for c in units])
    amounts = spark.range(1, 50001, 7).select((F.col("id") * F.lit(dec("0.01"))).cast("decimal(14,2)").alias("amount"))
    rows = amounts.withColumn("source", F.explode(codes)).withColumn("target", F.explode(codes))
    done = fx.convert(rows, matrix, "amount", "source", F.col("target")).collect()
    getcontext().prec = 50
    for r in done:
        value = r.amount * units[r.target] / units[r.source]
        assert r.amt == value.quantize(Decimal("0.01"), ROUND_HALF_UP), r


def test_missing_pair_is_an_error_or_split_off(spark, matrix):
    rows = spark.createDataFrame([(dec(1), "USD"), (dec(2), "JPY")], "amount decimal(14,2), currency string")
    with pytest.raises(Exception, match="no exchange rate for JPY to USD"):
        fx.convert(rows, matrix, "amount", "currency", "USD").collect()
    usable, other = fx.split_convertible(rows, matrix, "currency", "USD")
    assert usable.count() == 1 and other.first().currency == "JPY"
    same = fx.convert(rows, matrix, "amount", "currency", F.col("currency")).collect()
    assert [r.amt for r in same] == [1, 2]


def test_display_currency_per_user(spark, matrix, users, demo):
    other = demo.withColumn("user_id", F.lit(2).cast("bigint"))
    shown = fx.to_display(demo.unionByName(other), matrix, users=users)
    sums = {r[0]: r[1] for r in shown.groupBy("user_id").agg(F.sum("amt")).collect()}
    assert sums[2] == (sums[1] * dec("0.92")).quantize(dec("0.01"))


def payload_rows(spark, *texts):
    return fx_payloads.parse_fx_payloads(spark.createDataFrame([(t,) for t in texts], "value string"))


def test_payloads(spark, tmp_path):
    good = {
        "amount": 1.0,
        "base": "USD",
        "rates": {
            "2026-06-29": {"AUD": 1.4493, "EUR": 0.87673, "PHP": 61.184},
            "2026-07-03": {"AUD": 1.4413, "EUR": 0.87352, "PHP": 61.442},
        },
    }
    found = {(r.as_of, r.quote_currency): r.rate for r in payload_rows(spark, json.dumps(good)).collect()}
    assert found[(date(2026, 6, 29), "AUD")] == dec("1.4493")
    assert found[(date(2026, 7, 3), "PHP")] == dec("61.442")
    half = {"base": "USD", "rates": {"2026-06-29": {"AUD": 1.4}, "soon": {"AUD": 1.5}}}
    worded = {"base": "USD", "rates": {"2026-06-29": {"AUD": "much"}}}
    bad = ['{"nope": true}', "not json", json.dumps(half), json.dumps(worded), '{"rates": {}}']
    assert payload_rows(spark, *bad).count() == 0
    (tmp_path / "one.json").write_text(json.dumps(good, indent=2))
    assert fx_payloads.read_fx_payloads(spark, str(tmp_path), one_per_file=True).count() == 6


def history(spark, *rows):
    return spark.createDataFrame([("USD", q, dec(r), date(2026, 7, d)) for q, r, d in rows], HISTORY)


def test_series_and_day_move(spark):
    held = history(spark, ("PHP", "58.50", 1), ("PHP", "58.70", 2), ("AUD", "1.50", 1), ("JPY", 150, 2))
    series = fx.fx_series(held, "usd", None, date(2026, 7, 2)).collect()
    assert [r.as_of.day for r in series] == [1, 2]
    assert series[1].rates == {"PHP": dec("58.7")}  # only region currencies
    move = fx.fx_latest_move(held.filter("quote_currency = 'PHP'")).first()
    assert move.move == dec("0.2") and move.move_percent == pytest.approx(0.2 / 58.5 * 100)


def test_history_and_current_updates(spark):
    held = history(spark, ("PHP", 58, 1), ("PHP", 59, 2))
    fetched = history(spark, ("PHP", 60, 2), ("PHP", 61, 3)).withColumn("seq", F.lit(1))
    merged = {r.as_of.day: r.rate for r in fx.upsert_fx_history(held, fetched).collect()}
    assert merged == {1: 58, 2: 60, 3: 61}
    current = history(spark, ("PHP", 58, 3), ("AUD", "1.5", 9))
    late = history(spark, ("PHP", 60, 3), ("PHP", 99, 1), ("AUD", "1.6", 3)).withColumn("seq", F.lit(1))
    now = {r.quote_currency: (r.rate, r.as_of.day) for r in fx.upsert_fx_current(current, late).collect()}
    assert now == {"PHP": (60, 3), "AUD": (dec("1.5"), 9)}


def test_coverage_needs_fresh_and_far_enough_history(spark):
    held = history(spark, ("PHP", 58, 4), ("PHP", 59, 6))
    asked = spark.createDataFrame(
        [
            ("USD", date(2026, 7, 4), date(2026, 7, 7)),
            ("USD", date(2026, 7, 4), date(2026, 7, 8)),
            ("USD", date(2026, 5, 7), date(2026, 7, 6)),
            ("EUR", date(2026, 7, 4), date(2026, 7, 6)),
        ],
        "base_currency string, start_on date, end_on date",
    )
    found = fx.fx_coverage(held, asked).collect()
    answers = {(r.base_currency, r.start_on, r.end_on): r.covered for r in found}
    assert list(answers.values()).count(True) == 1
    assert answers[("USD", date(2026, 7, 4), date(2026, 7, 7))]
