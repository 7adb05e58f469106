"""Merging a batch of upserts and deletes into a table by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

# A stored column that each update renews, where the batch carries it.
RENEWED = "updated_at"


def last_of_batch(
    base: DataFrame, changes: DataFrame, key: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """What a batch (seq, op, key, values) leaves of each key, for ``merged_by_key``.

    Columns: the key; ``_last``, the op, values and renewal time of the last change; ``_made``, the
    base's other columns as the change that made the row anew gave them; ``_new``, whether the
    batch deleted the key before.
    """
    others = [c for c in base.columns if c not in (*key, *values) and c in changes.columns]
    renewed = [RENEWED] if RENEWED in others else []
    gone = F.when(F.col("op") != "upsert", F.col("seq"))
    placed = changes.withColumn("_gone", F.max(gone).over(Window.partitionBy(*key)))
    after = (F.col("op") == "upsert") & (F.col("_gone").isNull() | (F.col("seq") > F.col("_gone")))
    made = F.struct(F.lit(True).alias("_made"), *others)
    return placed.groupBy(*key).agg(
        F.max_by(F.struct("op", *values, *renewed), "seq").alias("_last"),
        F.min_by(made, F.when(after, F.col("seq"))).alias("_made"),
        F.bool_or(F.col("_gone").isNotNull()).alias("_new"),
    )


def merged_by_key(base: DataFrame, last: DataFrame) -> DataFrame:
    """The table after a batch: untouched rows whole, updated ones with their other columns kept.

    New rows take those columns (id, creation time) from the batch, or NULL where it has none.
    The table is only semi- and anti-joined to the batch, so a small batch leaves it unshuffled.
    """
    key = [c for c in last.columns if not c.startswith("_")]
    given, made = (set(last.schema[c].dataType.names) for c in ("_last", "_made"))
    touched = last.select(*key)
    held = base.join(touched, key, "left_semi")
    rows = last.filter(F.col("_last.op") == "upsert").join(held, key, "left")

    def value(name: str):
        if name in key:
            return F.col(name)
        stored = F.when(~F.col("_new"), F.col(name))
        if name in given:
            fresh = F.col(f"_last.{name}")
            return F.coalesce(fresh, stored) if name == RENEWED else fresh
        return F.coalesce(stored, F.col(f"_made.{name}")) if name in made else stored

    kinds = dict(base.dtypes)
    fresh = rows.select(*[value(n).cast(kinds[n]).alias(n) for n in base.columns])
    return base.join(touched, key, "left_anti").unionByName(fresh)
