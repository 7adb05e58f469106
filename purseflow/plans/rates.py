"""Answers to requests for exchange rates, out of the stored history and newly loaded points."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from purseflow.functions.periods import FX_MAX_DAYS, fx_range_bounds
from purseflow.operators.fx import fx_coverage, region_quotes, upsert_fx_current, upsert_fx_history
from purseflow.schemas import REGION_CURRENCY


class RateAnswers(NamedTuple):
    history: DataFrame  # with the loaded points
    current: DataFrame  # refreshed from each load's latest day
    points: DataFrame  # request_id, as_of, quote_currency, rate
    requests: DataFrame  # request_id, base_currency, start_on, end_on, live, as_of, quotes


def fx_rates_for_requests(
    requests: DataFrame,
    history: DataFrame,
    current: DataFrame,
    loaded: DataFrame,
    max_days: int = FX_MAX_DAYS,
) -> RateAnswers:
    """Answer every (request_id, base_currency, start_on, end_on); a NULL start means a week.

    Ranges are clamped to ``max_days``. A request that the history covers needs no load; of the
    others, the ``loaded`` points (request_id, base_currency, quote_currency, as_of, rate, seq) are
    merged into history and current rates first. ``live`` tells that a request was covered or
    loaded, ``as_of`` is its newest day, NULL without points. Requests meet the history by base and
    month, so no request is compared with all of it.
    """
    start, end = fx_range_bounds(F.col("start_on"), F.col("end_on"), max_days)
    asked = requests.select(
        "request_id",
        F.upper("base_currency").alias("base_currency"),
        start.alias("start_on"),
        end.alias("end_on"),
    )
    judged = fx_coverage(history, asked)
    wanted = judged.filter(~F.col("covered")).select("request_id")
    used = loaded.join(wanted, "request_id", "left_semi")
    merged = upsert_fx_history(history, used.drop("request_id"))
    refreshed = upsert_fx_current(current, used.drop("request_id"))
    codes = sorted(set(REGION_CURRENCY.values()))
    quotes = F.create_map(
        *[x for c in codes for x in (F.lit(c), F.array(*[F.lit(q) for q in region_quotes(c)]))]
    )
    every = F.array(*[F.lit(c) for c in codes])
    listed = F.coalesce(F.try_element_at(quotes, F.col("base_currency")), every)
    months = F.sequence(F.trunc("start_on", "month"), F.trunc("end_on", "month"), F.expr("interval 1 month"))
    spread = asked.select("*", F.explode(months).alias("_month"))
    days = merged.select(
        "base_currency", "quote_currency", "as_of", "rate", F.trunc("as_of", "month").alias("_month")
    ).filter(F.col("quote_currency").isin(codes) & (F.col("quote_currency") != F.col("base_currency")))
    points = (
        spread.join(days, ["base_currency", "_month"])
        .filter(F.col("as_of").between(F.col("start_on"), F.col("end_on")))
        .select("request_id", "as_of", "quote_currency", "rate")
    )
    newest = points.groupBy("request_id").agg(F.max("as_of").alias("as_of"))
    has_load = used.select("request_id").distinct().withColumn("_loaded", F.lit(True))
    answers = (
        judged.join(has_load, "request_id", "left")
        .join(newest, "request_id", "left")
        .select(
            "request_id",
            "base_currency",
            "start_on",
            "end_on",
            (F.col("covered") | F.coalesce("_loaded", F.lit(False))).alias("live"),
            "as_of",
            listed.alias("quotes"),
        )
    )
    return RateAnswers(merged, refreshed, points, answers)
