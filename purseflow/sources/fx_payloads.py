"""Exchange-rate payloads: {"base": ..., "rates": {day: {currency: rate}}}."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from purseflow.schemas import PIVOT_CURRENCY

PAYLOAD = T.StructType(
    [
        T.StructField("base", T.StringType()),
        T.StructField(
            "rates",
            T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())),
        ),
    ]
)
RATE = "decimal(18,8)"


def _usable(days: Column) -> Column:
    """A payload counts as a whole: one bad day (not yyyy-mm-dd) or rate discards all of it."""
    return F.forall(
        F.map_entries(days),
        lambda day: day["key"].rlike(r"^\d{4}-\d{2}-\d{2}$")
        & day["key"].try_cast("date").isNotNull()
        & day["value"].isNotNull()
        & F.forall(
            F.map_entries(day["value"]), lambda quote: quote["value"].try_cast(RATE).isNotNull()
        ),
    )


def _last_entries(entries: Column) -> Column:
    """A map without earlier entries of a key that it repeats; JSON objects may repeat keys."""
    keys = F.map_keys(entries)
    pairs = F.filter(
        F.map_entries(entries),
        lambda entry, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), entry["key"]),
    )
    return F.map_from_entries(pairs)


def parse_fx_payloads(
    payloads: DataFrame, text: str = "value", default_base: str = PIVOT_CURRENCY
) -> DataFrame:
    """Rows (base, quote, as_of, rate) of a column of JSON payloads; other columns are kept.

    Malformed payloads give no rows and do not fail the job. Of a day or quote that a payload has
    more than once, the last entry counts.
    """
    parsed = F.from_json(text, PAYLOAD)
    others = [name for name in payloads.columns if name != text]
    days = (
        payloads.select(*others, parsed.alias("_p"))
        .filter(F.col("_p.rates").isNotNull() & _usable(F.col("_p.rates")))
        .select(
            *others,
            F.upper(F.coalesce("_p.base", F.lit(default_base))).alias("base_currency"),
            F.explode(_last_entries(F.col("_p.rates"))).alias("_day", "_quotes"),
        )
    )
    return days.select(
        *others,
        "base_currency",
        "_day",
        F.explode(_last_entries(F.col("_quotes"))).alias("quote_currency", "_rate"),
    ).select(
        *others,
        "base_currency",
        "quote_currency",
        F.col("_day").cast("date").alias("as_of"),
        F.col("_rate").cast(RATE).alias("rate"),
    )


def read_fx_payloads(
    spark: SparkSession, path: str, one_per_file: bool = False, **options
) -> DataFrame:
    """Payload files: one payload per line, or one per file."""
    return parse_fx_payloads(spark.read.text(path, wholetext=one_per_file), **options)


def fx_payload_text(base: Column, rates: Column) -> Column:
    """The payload of a base and a day-to-quotes map."""
    return F.to_json(F.struct(base.alias("base"), rates.alias("rates")))
