"""Reading and writing the ledger tables with fixed schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from purseflow.schemas import ENUM_VALUES, MONTH_COLUMN, TABLES
from purseflow.sources.csv_export import CSV_OPTIONS

# Fact tables are stored by month, so that a dated report reads only its months.
PARTITIONED = {"transactions": "occurred_on"}


def _enum_value(name: str) -> Column:
    """Stored enum names become values; values pass through."""
    mapping = F.create_map(*[F.lit(x) for pair in ENUM_VALUES[name].items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, F.col(name)), F.col(name))


def normalised(df: DataFrame) -> DataFrame:
    enums = [name for name in df.columns if name in ENUM_VALUES]
    return reduce(lambda out, name: out.withColumn(name, _enum_value(name)), enums, df)


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """One table below ``root``; parquet, orc, csv (with header) or json."""
    schema = TABLES[name]
    if name in PARTITIONED:
        schema = T.StructType([*schema.fields, T.StructField(MONTH_COLUMN, T.DateType())])
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS).option("multiLine", True)
    df = reader.format(fmt).load(f"{root.rstrip('/')}/{name}")
    return normalised(df)


def read_ledger(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name, fmt) for name in TABLES}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the table's columns; missing ones become NULL."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in TABLES[name].fields
        ]
    )


def write_table(
    df: DataFrame, root: str, name: str, fmt: str = "parquet", mode: str = "errorifexists"
) -> None:
    """Write one table, facts in one folder per month.

    The rebalance hint lets adaptive execution split a busy month over several tasks and write
    quiet months in few files.
    """
    rows = conform(df, name)
    if name in PARTITIONED:
        month = F.trunc(F.col(PARTITIONED[name]), "month")
        rows = rows.withColumn(MONTH_COLUMN, month).hint("rebalance", F.col(MONTH_COLUMN))
    writer = rows.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS)
    if name in PARTITIONED:
        writer = writer.partitionBy(MONTH_COLUMN)
    writer.save(f"{root.rstrip('/')}/{name}")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
