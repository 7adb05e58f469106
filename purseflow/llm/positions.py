"""Positions of rows in a total order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from purseflow.session import staged

# monotonically_increasing_id: the task's number above this bit, the row's place in the task below.
_TASK_BIT = 33


def in_order(rows: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``rows``, staged, with ``task`` and ``place``: range partitions in order, and the row's place
    from 0 within its own.

    ``order`` must tell all rows apart that may not lie in one task together.
    """
    placed = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id())
    )
    return staged(
        placed.withColumn("task", F.shiftright("place", _TASK_BIT)).withColumn(
            "place", F.col("place").bitwiseAND((1 << _TASK_BIT) - 1)
        ),
        label,
    )


def task_offsets(placed: DataFrame) -> DataFrame:
    """(task, offset, total): rows in earlier tasks and in all. One row per task of the sort."""
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sizes = placed.groupBy("task").agg(F.count(F.lit(1)).alias("rows"))
    return sizes.select(
        "task",
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"),
        F.sum("rows").over(every).alias("total"),
    )
