"""Balances kept per user and month, so that reports read the months they show and no others.

``nets`` has one row per user and month with transactions: ``net``, the signed sum in the user's
display currency, rounded per transaction, and ``entries``, the number of rows. It is brought up to
date by the signed difference that a change batch makes. A new exchange rate changes converted
amounts of old rows; then the nets are computed anew.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from purseflow.functions.money import money_sum, signed
from purseflow.functions.periods import as_day
from purseflow.operators.ledger import filter_transactions, newest_first, oldest_first
from purseflow.operators.reports import daily_totals
from purseflow.operators.skew import running_sum, top_k
from purseflow.schemas import MONTH_COLUMN

KEY = ["user_id", "month"]


def month_nets(converted: DataFrame) -> DataFrame:
    """(user_id, month, net, entries) of converted transactions; a partial aggregate."""
    month = F.trunc("occurred_on", "month").alias("month")
    rows = converted.drop(MONTH_COLUMN).filter(F.col("occurred_on").isNotNull())
    return rows.groupBy("user_id", month).agg(
        money_sum(signed(F.col("amt"))).alias("net"), F.count(F.lit(1)).alias("entries")
    )


def net_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed difference of the nets, from the changed rows (converted) before and after."""
    old = month_nets(before).select(*KEY, (-F.col("net")).alias("net"), (-F.col("entries")).alias("entries"))
    return (
        old.unionByName(month_nets(after))
        .groupBy(*KEY)
        .agg(money_sum(F.col("net")).alias("net"), F.sum("entries").alias("entries"))
        .filter("net <> 0 or entries <> 0")
    )


def updated_nets(nets: DataFrame, differences: DataFrame) -> DataFrame:
    """Nets after a batch; months without rows left are gone.

    The nets are only semi- and anti-joined to the batch's differences, so a small batch leaves
    them unshuffled.
    """
    touched = differences.select(*KEY)
    moved = (
        nets.join(touched, KEY, "left_semi")
        .select(*KEY, "net", "entries")
        .unionByName(differences.select(*KEY, "net", "entries"))
        .groupBy(*KEY)
        .agg(money_sum(F.col("net")).alias("net"), F.sum("entries").alias("entries"))
        .filter("entries <> 0")
    )
    return nets.join(touched, KEY, "left_anti").select(*KEY, "net", "entries").unionByName(moved)


def month_balances(nets: DataFrame) -> DataFrame:
    """Nets with the ``opening`` and ``closing`` balance of each month; a window over months."""
    line = Window.partitionBy("user_id").orderBy("month")
    closing = F.sum("net").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return nets.withColumn("closing", closing.cast("decimal(18,2)")).withColumn(
        "opening", (F.col("closing") - F.col("net")).cast("decimal(18,2)")
    )


def opening_balances(nets: DataFrame, start: Column | date | str) -> DataFrame:
    """(user_id, opening): each user's balance when the month of ``start`` begins."""
    earlier = nets.filter(F.col("month") < F.trunc(as_day(start), "month"))
    return earlier.groupBy("user_id").agg(money_sum(F.col("net")).alias("opening"))


def _from_month(start: Column | date | str) -> Column:
    return F.trunc(as_day(start), "month")


def running_balance_kept(
    nets: DataFrame, converted: DataFrame, start: Column | date | str, end: Column | date | str
) -> DataFrame:
    """Daily totals of a range with the all-time balance after each day.

    Transactions are read from the first month of the range on; all before is in the nets.
    """
    days = daily_totals(filter_transactions(converted, _from_month(start), end))
    line = Window.partitionBy("user_id").orderBy("occurred_on")
    here = F.sum("net").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        days.withColumn("_here", here)
        .join(opening_balances(nets, start), "user_id", "left")
        .withColumn("balance", (F.col("_here") + F.coalesce("opening", F.lit(0))).cast("decimal(18,2)"))
        .filter(F.col("occurred_on") >= as_day(start))
        .drop("_here", "opening")
    )


def transaction_balance_kept(
    nets: DataFrame, converted: DataFrame, start: Column | date | str, end: Column | date | str
) -> DataFrame:
    """Transactions of a range with the all-time balance after each one; reads its months only."""
    rows = filter_transactions(converted, _from_month(start), end)
    here = running_sum(rows, "user_id", "occurred_on", oldest_first(), signed(F.col("amt")), "_here")
    return (
        here.join(opening_balances(nets, start), "user_id", "left")
        .withColumn("balance", (F.col("_here") + F.coalesce("opening", F.lit(0))).cast("decimal(18,2)"))
        .filter(F.col("occurred_on") >= as_day(start))
        .drop("_here", "opening")
    )


def balance_at_kept(nets: DataFrame, converted: DataFrame, day: Column | date | str) -> DataFrame:
    """Each user's all-time balance after a day; reads that day's month only."""
    rows = filter_transactions(converted, _from_month(day), day)
    here = rows.groupBy("user_id").agg(money_sum(signed(F.col("amt"))).alias("_here"))
    both = opening_balances(nets, day).join(here, "user_id", "full")
    total = F.coalesce("opening", F.lit(0)) + F.coalesce("_here", F.lit(0))
    return both.select("user_id", total.cast("decimal(18,2)").alias("balance"))


def months_of_newest(nets: DataFrame, limit: int, asked: DataFrame | None = None) -> DataFrame:
    """(user_id, month) of the months that hold each asked user's newest ``limit`` rows."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    mine = nets if asked is None else nets.join(asked.select("user_id").distinct(), "user_id", "left_semi")
    newer = Window.partitionBy("user_id").orderBy(F.desc("month")).rowsBetween(Window.unboundedPreceding, -1)
    counted = mine.withColumn("_newer", F.coalesce(F.sum("entries").over(newer), F.lit(0)))
    return counted.filter(F.col("_newer") < limit).select(*KEY)


def newest_transactions(
    nets: DataFrame, tx: DataFrame, limit: int, asked: DataFrame | None = None
) -> DataFrame:
    """The newest rows of every asked user, numbered in ``position``, from few months.

    The counts in ``nets`` tell how far back each user's rows reach, so no month is read that
    holds none of them: the months are broadcast (as many as the calendar has) and prune folders.
    Rows without a day are not listed.
    """
    wanted = months_of_newest(nets, limit, asked)
    calendar = wanted.select(F.col("month").alias("_month")).distinct()
    held = F.col(MONTH_COLUMN) if MONTH_COLUMN in tx.columns else F.trunc("occurred_on", "month")
    near = tx.join(F.broadcast(calendar), held == F.col("_month"), "left_semi").drop(MONTH_COLUMN)
    rows = near.withColumn("_month", F.trunc("occurred_on", "month"))
    pairs = wanted.withColumnRenamed("month", "_month")
    mine = rows.join(pairs, ["user_id", "_month"], "left_semi").drop("_month")
    return top_k(mine, ["user_id"], newest_first(), limit, spread_by="id", rank="position")
