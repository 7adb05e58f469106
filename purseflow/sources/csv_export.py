"""CSV exports of expenses and of the rate history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from purseflow.functions.money import amount_text
from purseflow.operators.fx import convert
from purseflow.operators.ledger import filter_transactions, with_category_name
from purseflow.schemas import OUTBOUND

# The header of each export.
EXPENSE_COLUMNS = ("date", "category", "direction", "amount", "currency", "region", "description")
FX_COLUMNS = ("date", "base_currency", "quote_currency", "rate")

# Quotes are doubled and blanks kept, so that other readers of CSV get every text as it was.
CSV_OPTIONS = {
    "header": "true",
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def expense_rows(
    tx: DataFrame,
    categories: DataFrame,
    matrix: DataFrame | None = None,
    currency: str | None = None,
    **filters,
) -> DataFrame:
    """Expenses as text columns, keyed by user_id and id; ``currency`` adds a converted amount."""
    rows = with_category_name(filter_transactions(tx, direction=OUTBOUND, **filters), categories)
    extra = []
    if currency:
        code = currency.upper()
        rows = convert(rows, matrix, "amount", "currency", code, "_shown")
        extra = [amount_text(F.col("_shown")).alias(f"amount_{code}")]
    note = F.col("description") if "description" in rows.columns else F.lit(None)
    return rows.select(
        "user_id",
        "id",
        F.date_format("occurred_on", "yyyy-MM-dd").alias("date"),
        F.col("category_name").alias("category"),
        "direction",
        amount_text(F.col("amount")).alias("amount"),
        "currency",
        F.coalesce("region", F.lit("")).alias("region"),
        F.coalesce(note.cast("string"), F.lit("")).alias("description"),
        *extra,
    )


def write_expenses(rows: DataFrame, path: str, per_user_folders: bool = False) -> None:
    """Write export rows ordered by user, date and id.

    Range partitioning keeps each user's rows together and in order over the part files, and
    splits a very large user over several files. ``per_user_folders`` makes one folder per
    user, for exports of a limited set of users.
    """
    order = ["user_id", "date", "id"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = placed.drop("id").write.mode("errorifexists").options(**CSV_OPTIONS)
    writer = writer.option("emptyValue", "")
    if per_user_folders:
        writer = writer.partitionBy("user_id")
    writer.csv(path)


def export_expenses(
    tx: DataFrame,
    categories: DataFrame,
    path: str,
    matrix: DataFrame | None = None,
    currency: str | None = None,
    per_user_folders: bool = False,
    **filters,
) -> None:
    write_expenses(
        expense_rows(tx, categories, matrix, currency, **filters), path, per_user_folders
    )


def fx_history_rows(history: DataFrame, base: str) -> DataFrame:
    return (
        history.filter(F.col("base_currency") == base.upper())
        .orderBy("as_of", "quote_currency")
        .select(
            F.date_format("as_of", "yyyy-MM-dd").alias("date"),
            "base_currency",
            "quote_currency",
            amount_text(F.col("rate"), 6).alias("rate"),
        )
    )


def export_fx_history(history: DataFrame, base: str, path: str) -> None:
    fx_history_rows(history, base).write.mode("errorifexists").options(**CSV_OPTIONS).csv(path)


def read_export(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """An export read back as text, also over several lines; absent values are empty text."""
    schema = ", ".join(f"`{name}` string" for name in columns)
    reader = spark.read.schema(schema).options(**CSV_OPTIONS).option("multiLine", True)
    return reader.csv(path).fillna("")
