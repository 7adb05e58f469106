"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# Settings a cluster job should start with; all are ordinary Spark options.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # HotSpot compiles methods up to 8000 bytes only. Payroll stages are larger fused into one
    # method; beyond the limit Spark generates them as many small ones instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Column expressions are built in loops; recording a call site for each doubles that time.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# Input per shuffle partition that adaptive execution starts from; it merges partitions that turn
# out small, but adds none.
PARTITION_BYTES = 128 << 20


def shuffle_settings(input_bytes: int) -> dict[str, str]:
    """Initial shuffle partitions for a job over so many bytes, at least Spark's usual number."""
    number = max(200, -(-input_bytes // PARTITION_BYTES))
    return {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(number)}


def build_session(
    app: str = "purseflow", master: str | None = None, input_bytes: int | None = None, **extra: str
) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    sized = shuffle_settings(input_bytes) if input_bytes else {}
    for key, value in {**RECOMMENDED, **sized, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few constant rows as a local relation, whose size the planner knows."""
    names = StructType.fromDDL(schema).names
    columns = {name: [row[i] for row in rows] for i, name in enumerate(names)}
    return spark.createDataFrame(pa.table(columns), schema=schema)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, a folder in the warehouse, which all
    executors reach as well."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Several outputs then share one computation, and the planner sees the table's true size
    instead of an estimate multiplied through joins.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
