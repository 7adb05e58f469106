"""Versions of the stored transactions: a change rewrites the months it touches, and no others.

Below the table's root lie

    data/batch=<id>/month=<first day>/   the rows of a month as one change left them
    keys/batch=<id>/                     which ids those months hold (``key_index``)
    versions/<number>.json               which batch holds each month

A version file is written under another name and renamed without replacing an existing one, so
readers see the old or the new version, and of two writers that start from the same version one
gets a ``VersionConflict``. A batch that no version names is never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from purseflow.operators import changes as edits, key_index
from purseflow.schemas import MONTH_COLUMN, TABLES
from purseflow.session import staged
from purseflow.sources.tables import conform

TABLE = "transactions"
# Folder that Spark writes rows without a date to.
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"
_SCHEMA = T.StructType(
    [*TABLES[TABLE].fields, T.StructField("batch", T.StringType()), T.StructField(MONTH_COLUMN, T.DateType())]
)


class VersionConflict(RuntimeError):
    """Another writer has made the version this one meant to make."""


@dataclass(frozen=True)
class Version:
    """A version's number, and the batch and row count of every month that has rows."""

    number: int
    batches: dict[str, str]
    rows: dict[str, int]

    def months_of(self, batch: str) -> list[str]:
        return sorted(m for m, b in self.batches.items() if b == batch)


def _files(spark: SparkSession, path: str):
    """The folder's file context and Hadoop's path class; both are the driver's."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop.FileContext.getFileContext(at.toUri(), conf), hadoop.Path, at.getFileSystem(conf)


def _version_path(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/versions/{number:012d}.json"


def latest_number(spark: SparkSession, root: str) -> int:
    """Number of the newest version, 0 if there is none."""
    folder = f"{root.rstrip('/')}/versions"
    _, path, files = _files(spark, folder)
    if not files.exists(path(folder)):
        return 0
    names = [s.getPath().getName() for s in files.listStatus(path(folder))]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def open_version(spark: SparkSession, root: str, number: int | None = None) -> Version:
    """The version with a number, or the newest one."""
    number = latest_number(spark, root) if number is None else number
    if number < 1:
        raise FileNotFoundError(f"no version of {TABLE} in {root}")
    text = spark.read.text(_version_path(root, number), wholetext=True).first()[0]
    held = json.loads(text)
    return Version(held["number"], held["batches"], held["rows"])


def _publish(spark: SparkSession, root: str, version: Version) -> None:
    """Make the version visible, unless one of its number is."""
    final = _version_path(root, version.number)
    draft = f"{root.rstrip('/')}/versions/.{uuid.uuid4().hex}"
    context, path, files = _files(spark, final)
    out = files.create(path(draft), False)
    out.write(bytearray(json.dumps(version.__dict__, sort_keys=True).encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(path(draft), path(final), options)
    except Exception as failed:
        files.delete(path(draft), False)
        if "FileAlreadyExists" in str(failed):
            raise VersionConflict(f"version {version.number} exists") from failed
        raise


def rows_of(spark: SparkSession, root: str, version: Version) -> DataFrame:
    """All rows of a version, with ``month`` as a partition column to filter on."""
    data = f"{root.rstrip('/')}/data"
    paths = [f"{data}/batch={b}/{MONTH_COLUMN}={m}" for m, b in sorted(version.batches.items())]
    if not paths:
        return spark.createDataFrame([], _SCHEMA).drop("batch")
    read = spark.read.schema(_SCHEMA).option("basePath", data)
    return read.parquet(*paths).drop("batch")


def read_version(spark: SparkSession, root: str, number: int | None = None) -> DataFrame:
    return rows_of(spark, root, open_version(spark, root, number))


def in_months(rows: DataFrame, months: list[str]) -> DataFrame:
    """Rows of the given months; the condition prunes folders."""
    named = [F.lit(m).cast("date") for m in months if m != NO_MONTH]
    test = F.col(MONTH_COLUMN).isin(*named) if named else F.lit(False)
    return rows.filter(test | F.col(MONTH_COLUMN).isNull() if NO_MONTH in months else test)


def month_name(day: Column) -> Column:
    """The folder value of a day's month."""
    return F.coalesce(F.trunc(day, "month").cast("string"), F.lit(NO_MONTH))


def _write_batch(df: DataFrame, root: str) -> tuple[str, dict[str, int]]:
    """Write rows by month, and the index of their ids; the batch's name and rows per month.

    The rebalance hint splits a busy month over several tasks.
    """
    batch, root = uuid.uuid4().hex, root.rstrip("/")
    rows = conform(df, TABLE).withColumn(MONTH_COLUMN, F.trunc("occurred_on", "month"))
    path = f"{root}/data/batch={batch}"
    rows.hint("rebalance", F.col(MONTH_COLUMN)).write.partitionBy(MONTH_COLUMN).parquet(path)
    written = df.sparkSession.read.schema(_SCHEMA).parquet(path)
    named = F.coalesce(F.col(MONTH_COLUMN).cast("string"), F.lit(NO_MONTH))
    counts = written.groupBy(named.alias("m")).agg(F.count(F.lit(1)).alias("n"))
    # One row per month.
    sizes = {r["m"]: r["n"] for r in counts.collect()}
    index = key_index.build(written.select(named.alias("part"), "id"), sizes)
    index.write.parquet(f"{root}/keys/batch={batch}")
    return batch, sizes


def create_versions(df: DataFrame, root: str) -> Version:
    """Store transactions as version 1 of a new table."""
    batch, sizes = _write_batch(df, root)
    version = Version(1, {m: batch for m in sizes}, sizes)
    _publish(df.sparkSession, root, version)
    return version


def months_that_may_hold(
    spark: SparkSession, root: str, version: Version, ids: DataFrame
) -> list[str]:
    """Months that may hold one of the ``ids`` (id); all that do are among them."""
    if not version.batches:
        return []
    keys = f"{root.rstrip('/')}/keys"
    used = sorted(set(version.batches.values()))
    read = spark.read.schema(f"{key_index.SCHEMA}, batch string").option("basePath", keys)
    index = read.parquet(*[f"{keys}/batch={b}" for b in used])
    owners = F.create_map(*[F.lit(x) for pair in version.batches.items() for x in pair])
    current = index.filter(F.try_element_at(owners, F.col("part")) == F.col("batch"))
    return key_index.parts_that_may_hold(current.drop("batch"), ids)


def apply_batch(
    spark: SparkSession, root: str, changes: DataFrame, categories: DataFrame, users: DataFrame
) -> tuple[Version, Version, DataFrame]:
    """(version before, version after, rejected rows) of a batch of inserts, patches and deletes.

    Rules are those of ``changes.apply_transactions``. Ids are looked up only in months whose index
    may hold them; months that the batch touches are rewritten, all others keep their files. A
    batch that changes nothing makes no version.
    """
    before = open_version(spark, root)
    rows = rows_of(spark, root, before)
    changes = staged(changes, "changes")
    asked = changes.select("id").filter(F.col("id").isNotNull()).distinct()
    known = in_months(rows, months_that_may_hold(spark, root, before, asked))
    effects = edits.transaction_effects(known.drop(MONTH_COLUMN), changes, categories, users)
    touched = effects.touched_days().select(month_name(F.col("day")).alias("m")).distinct()
    # At most one row per month.
    months = sorted(r["m"] for r in touched.collect())
    if not months:
        return before, before, effects.rejected
    old = in_months(rows, months).drop(MONTH_COLUMN)
    batch, sizes = _write_batch(edits.merge_effects(old, effects), root)
    batches = {m: b for m, b in before.batches.items() if m not in months}
    counts = {m: n for m, n in before.rows.items() if m not in months}
    after = Version(
        before.number + 1, {**batches, **{m: batch for m in sizes}}, {**counts, **sizes}
    )
    _publish(spark, root, after)
    return before, after, effects.rejected


def changed_months(before: Version, after: Version) -> list[str]:
    """Months whose files differ between two versions."""
    every = {*before.batches, *after.batches}
    return sorted(m for m in every if before.batches.get(m) != after.batches.get(m))
