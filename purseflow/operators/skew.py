"""Joins, windows and rankings that stay parallel when one key holds a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from purseflow.session import staged

# Narrow tables with more rows than this are joined by shuffle instead of broadcast.
MAX_BROADCAST_KEYS = 200_000
# Largest k that Spark's own window group limit prunes before the shuffle.
GROUP_LIMIT_K = 1000
# Rows of a task whose rows grow many times longer or more after the exchange, or that keeps
# several tables of them.
ROWS_PER_TASK = 50_000
# A key on more than this share of the rows is surely among a frequency sketch's entries.
FREQUENT = 1 / 128

_counted: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def pinned(df: DataFrame, max_rows: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """Cache a dimension, count it, and mark it for broadcast only if the count allows.

    A larger one is returned as it is: its cached size is exact, so the planner picks a join by
    spark.sql.autoBroadcastJoinThreshold and adaptive execution splits skewed partitions.
    """
    cached = df.persist(StorageLevel.MEMORY_AND_DISK)
    return F.broadcast(cached) if cached.count() <= max_rows else cached


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether a table has few enough rows to be broadcast; counted once per DataFrame."""
    most = MAX_BROADCAST_KEYS if max_rows is None else max_rows
    if df not in _counted:
        _counted[df] = df.limit(MAX_BROADCAST_KEYS + 1).count()
    return _counted[df] <= most


def dealt(df: DataFrame, keys: Sequence[str], label: str, rows: int | None = None) -> DataFrame:
    """Rows, staged and dealt by key to tasks of about ``rows`` rows each.

    For steps that unfold rows, or keep several tables of them, in the same stage: adaptive
    execution sizes that stage's tasks by the bytes it reads, so that they would hold ever more.
    """
    return dealt_stored(staged(df, label), keys, rows)


def dealt_stored(stored: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """The same for a table that is stored already, whose count is read off its files."""
    most = ROWS_PER_TASK if rows is None else rows
    number = max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // most))
    return stored.repartition(number, *keys)


def frequent_hashes(df: DataFrame, keys: Sequence[str], share: float = FREQUENT) -> list[int]:
    """Hashes of the keys that may hold more than a share of the rows, at most 1 / share of them.

    All that do are listed: ``freqItems`` is a Misra-Gries summary, merged from one per task.
    """
    found = df.select(F.xxhash64(*keys).alias("_h")).stat.freqItems(["_h"], share).first()
    return sorted(found[0] or [])


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    counted: DataFrame | None = None,
    max_rows: int | None = None,
    common: Column | None = None,
    share: float = FREQUENT,
) -> DataFrame:
    """Facts with the columns of a lookup that has one row per key, whatever the keys' skew.

    A lookup of up to ``max_rows`` rows is broadcast; ``counted`` is the table to count where the
    lookup derives from a longer-lived one. A larger lookup is split. Its ``common`` rows, if they
    are few enough, are broadcast. Of the other facts, those whose key is frequent by a sketch, or
    null, meet a broadcast of at most 1 / ``share`` lookup rows, and stay where they are as well.
    What is left is shuffled, and no key of it holds more than ``share`` of the facts.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    if is_small(lookup if counted is None else counted, max_rows):
        return facts.join(F.broadcast(lookup), keys, how)
    parts = []
    if common is not None:
        named = lookup.filter(common)
        if is_small(named, None if max_rows is None else max(max_rows, 1000)):
            parts.append(facts.join(F.broadcast(named), keys, "inner"))
            facts = facts.join(F.broadcast(named.select(*keys)), keys, "left_anti")
            lookup = lookup.join(F.broadcast(named.select(*keys)), keys, "left_anti")
    frequent = F.xxhash64(*keys).isin(frequent_hashes(facts, keys, share))
    absent = F.lit(False)
    for key in keys:
        absent = absent | F.col(key).isNull()
    here = facts.filter(frequent | absent)
    parts.append(here.join(F.broadcast(lookup.filter(frequent)), keys, how))
    parts.append(facts.filter(~frequent & ~absent).join(lookup.filter(~frequent), keys, how))
    columns = parts[-1].columns
    return reduce(DataFrame.unionByName, [part.select(*columns) for part in parts])


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    spread_by: str | None = None,
    rank: str = "_rank",
) -> DataFrame:
    """The first k rows per key, numbered in ``rank``.

    Up to k = 1000 Spark drops surplus rows before the shuffle; above, a first pass over
    (key, salt) does.
    """
    if k > GROUP_LIMIT_K and spread_by is not None:
        salted = df.withColumn("_salt", F.pmod(F.hash(spread_by), F.lit(64)))
        part = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_part", F.row_number().over(part)).filter(F.col("_part") <= k)
        df = df.drop("_part", "_salt")
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def running_sum(
    df: DataFrame,
    key: str,
    step: str,
    order: Sequence[Column],
    value: Column,
    out: str,
    kind: str = "decimal(18,2)",
    newest: tuple[Column, int] | None = None,
) -> DataFrame:
    """Cumulative sum of ``value`` per key, in two levels.

    ``order`` begins with ``step``, such as the day. Sums per (key, step) are partial aggregates
    and few per key; a window over them gives what each step opens with. Rows are shuffled once,
    by key and step, so that a key with very many rows spreads over its steps.

    ``newest``, a condition and a number k, keeps only the steps that each key's k newest rows
    with the condition lie in; older steps are in the opening sums, and their rows are dropped by
    the join.
    """
    rows = df.withColumn("_value", value)
    past = (Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy(step).rowsBetween(*past)
    wanted = F.count_if(newest[0]) if newest else F.lit(0)
    steps = rows.groupBy(key, step).agg(F.sum("_value").alias("_sum"), wanted.alias("_wanted"))
    opening = steps.withColumn("_open", F.sum("_sum").over(before))
    if newest:
        after = Window.partitionBy(key).orderBy(F.desc(step)).rowsBetween(*past)
        newer = F.coalesce(F.sum("_wanted").over(after), F.lit(0))
        opening = opening.withColumn("_newer", newer)
        opening = opening.filter((F.col("_newer") < newest[1]) & (F.col("_wanted") > 0))
    opening = opening.select(key, step, "_open")
    inside = Window.partitionBy(key, step).orderBy(*order)
    here = F.sum("_value").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = here + F.coalesce("_open", F.lit(0)).cast("decimal(28,2)")
    return rows.join(opening, [key, step]).withColumn(out, total.cast(kind)).drop("_value", "_open")


def previous_value(
    df: DataFrame, key: str, order: Sequence[Column], value: str, out: str
) -> DataFrame:
    """The ``value`` of the preceding row of the key; NULL on the first row."""
    return df.withColumn(out, F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
