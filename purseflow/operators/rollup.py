"""One aggregate of the transactions that all reports read.

The rollup has a row per user, category, direction and day (or month): the sum of the amounts,
the least id, and the number of rows. Its columns are named as in a converted transaction, and the
reports only add amounts up, so that each of them takes it in place of the transactions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from purseflow.functions.money import money_sum
from purseflow.operators.skew import dealt, dealt_stored
from purseflow.session import staged

GRAIN = ["user_id", "category_id", "direction"]
KEY = [*GRAIN, "occurred_on"]


def _added(rows: DataFrame, entries) -> DataFrame:
    return rows.groupBy(*KEY).agg(
        money_sum(F.col("amt")).alias("amt"), F.min("id").alias("id"), F.sum(entries).alias("entries")
    )


def daily_rollup(converted: DataFrame) -> DataFrame:
    """Sums by user, category, direction and day, staged: the transactions are read once.

    Amounts are rounded per transaction before they are added, so sums of the rollup equal sums of
    the rows. Regions and times of day are gone.

    Rows are staged and dealt by number, as hardly any are added up if users have few a day: a task
    would hold nearly all of its rows in both of its aggregates, besides what the join that it reads
    sorts. The files are as small, which bounds the rows of a task that scans them.
    """
    rows = dealt(converted.select(*KEY, "amt", "id"), KEY, "converted")
    return staged(_added(rows, F.lit(1)), "daily-rollup")


def monthly_rollup(daily: DataFrame) -> DataFrame:
    """The rollup by month, each row dated on the first; for reports over whole months."""
    dated = daily.withColumn("occurred_on", F.trunc("occurred_on", "month"))
    return staged(_added(dealt_stored(dated, KEY), F.col("entries")), "monthly-rollup")
