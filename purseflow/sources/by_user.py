"""Users and transactions stored in equal buckets of the user, so that they join where they lie.

Users whose rows are a large share of the table would make their bucket one long task. Their rows
are stored apart, in no buckets, and meet a broadcast of those few users; a frequency sketch finds
them. A user's rows lie in one of the two tables as a whole.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from purseflow.operators.fx import convert
from purseflow.operators.skew import FREQUENT, frequent_hashes
from purseflow.schemas import MONTH_COLUMN
from purseflow.session import fresh_path


@dataclass(frozen=True)
class ByUser:
    """Bucketed ``users`` and ``light`` transactions, and ``hot`` users' transactions."""

    users: DataFrame
    light: DataFrame
    hot: DataFrame
    hot_hashes: tuple[int, ...]

    def is_hot(self, user: str) -> Column:
        return F.xxhash64(user).isin(*self.hot_hashes) if self.hot_hashes else F.lit(False)

    def transactions(self) -> DataFrame:
        return self.light.unionByName(self.hot)

    def with_users(self, rows: str, columns: list[Column]) -> DataFrame:
        """``light`` or ``hot`` rows with columns of their user.

        Light rows and users have the same buckets, so neither side is exchanged. Hot users are at
        most as many as the sketch has entries, a proven bound for the broadcast.
        """
        people = self.users.select(F.col("id").alias("user_id"), *columns)
        if rows == "light":
            return self.light.join(people, "user_id")
        return self.hot.join(F.broadcast(people.filter(self.is_hot("user_id"))), "user_id")


def _save(df: DataFrame, root: str, name: str, key: str, buckets: int) -> DataFrame:
    """Write a table in buckets of ``key``, one file per bucket and month, and read it back."""
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    if MONTH_COLUMN in df.columns:
        writer = writer.partitionBy(MONTH_COLUMN)
    writer.format("parquet").option("path", f"{root}/{name}").saveAsTable(table)
    return df.sparkSession.table(table)


def save_by_user(
    spark: SparkSession,
    users: DataFrame,
    tx: DataFrame,
    buckets: int | None = None,
    root: str | None = None,
    share: float = FREQUENT,
) -> ByUser:
    """Store users and transactions by user; the tables' files lie in the shared folder.

    ``buckets`` is the number of tasks that later joins have, the number of shuffle partitions
    unless given. Transactions keep their month folders.
    """
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = root or fresh_path(spark, "by-user")
    hashes = tuple(frequent_hashes(tx, ["user_id"], share))
    rows = tx.drop(MONTH_COLUMN).withColumn(MONTH_COLUMN, F.trunc("occurred_on", "month"))
    hot = F.xxhash64("user_id").isin(*hashes) if hashes else F.lit(False)
    people = _save(users, root, "users", "id", buckets)
    light = _save(rows.filter(~hot), root, "light", "user_id", buckets)
    path = f"{root}/hot"
    rows.filter(hot).hint("rebalance", F.col(MONTH_COLUMN)).write.partitionBy(MONTH_COLUMN).parquet(path)
    apart = spark.read.schema(rows.schema).parquet(path).select(*light.columns)
    return ByUser(people, light, apart, hashes)


def base_amounts(stored: ByUser, matrix: DataFrame) -> DataFrame:
    """Transactions with ``amt`` in their user's base currency, each converted once.

    No transaction is exchanged between tasks. Rows of users that the users table lacks are left out.
    """
    base = [F.upper("base_currency").alias("display_currency")]
    parts = [
        convert(stored.with_users(rows, base), matrix, "amount", "currency", F.col("display_currency"))
        for rows in ("light", "hot")
    ]
    return parts[0].unionByName(parts[1])
