"""Exchange rates: rate matrix, conversion, rate history and rate updates."""

from __future__ import annotations

from datetime import date
from pyspark.sql import Column, DataFrame, Window, functions as F

from purseflow.functions.money import money
from purseflow.functions.periods import fx_range_bounds
from purseflow.operators.merging import last_of_batch, merged_by_key
from purseflow.operators.skew import is_small, lookup_join, top_k
from purseflow.schemas import MATRIX_RATE, MONEY, PIVOT_CURRENCY, REGION_CURRENCY

PAIR = ["base_currency", "quote_currency"]


def _up(rate: Column) -> Column:
    """Rates are kept with 16 decimals, rounded up: a rounded-down inverse would push amounts
    that lie exactly on half a cent below it."""
    return F.ceil(rate, F.lit(16)).cast(MATRIX_RATE)


def rate_matrix(rates: DataFrame, pivot: str = PIVOT_CURRENCY) -> DataFrame:
    """Best rate of every convertible pair: identity, direct, inverse, else via the pivot.

    At most currencies squared rows; pass the result through ``skew.pinned`` before reuse.
    """
    one = F.lit(1).cast("decimal(18,8)")
    rate = F.col("rate").cast("decimal(18,8)")
    base, quote = F.col("base_currency"), F.col("quote_currency")
    # Each leg is a fraction, so that no digit is lost before the final rounding.
    direct = rates.select(
        base, quote, rate.alias("num"), one.alias("den"), F.lit(1).alias("choice")
    )
    inverse = rates.filter(rate != 0).select(
        quote.alias("base_currency"),
        base.alias("quote_currency"),
        one.alias("num"),
        rate.alias("den"),
        F.lit(2).alias("choice"),
    )
    known = rates.select(base.alias("c")).union(rates.select(quote.alias("c"))).distinct()
    identity = known.select(
        F.col("c").alias("base_currency"),
        F.col("c").alias("quote_currency"),
        one.alias("num"),
        one.alias("den"),
        F.lit(0).alias("choice"),
    )
    # One leg per pair before the pivot join, so a pair quoted both ways gives one route.
    legs = (
        direct.union(inverse)
        .union(identity)
        .groupBy(*PAIR)
        .agg(F.min_by(F.struct("num", "den"), "choice").alias("leg"))
    )
    into = legs.filter(quote == pivot).select(
        base, quote.alias("via"), F.col("leg").alias("first")
    )
    out_of = legs.filter(base == pivot).select(
        base.alias("via"), quote, F.col("leg").alias("second")
    )
    routes = into.join(out_of, "via").join(legs, PAIR, "left_anti")

    n1, d1 = F.col("first.num"), F.col("first.den")
    n2, d2 = F.col("second.num"), F.col("second.den")
    num = F.when(n1 == 1, n2).otherwise(n1)
    den = F.when(d1 == 1, d2).otherwise(d1)
    both_direct = (d1 == 1) & (d2 == 1)
    both_inverse = (d1 != 1) & (d2 != 1)
    crossed = (
        F.when(both_direct, _up(n1 * n2))
        .when(both_inverse, _up(F.lit(1) / (d1 * d2)))
        .otherwise(_up(num / den))
    )
    quoted = legs.select(base, quote, _up(F.col("leg.num") / F.col("leg.den")).alias("rate"))
    return quoted.unionByName(routes.select(base, quote, crossed.alias("rate")))


def _quoted(
    df: DataFrame, matrix: DataFrame, source: Column, target: Column | str
) -> tuple[DataFrame, Column]:
    """df with the pair's rate in ``_rate``, and the target currency as a column."""
    lookup = matrix.select(
        F.col("base_currency").alias("_from"),
        F.col("quote_currency").alias("_to"),
        F.col("rate").alias("_rate"),
    )
    # Pairs are broadcast once their number is known to be small; currencies are skewed keys.
    sized = F.broadcast if is_small(matrix) else lambda table: table
    if isinstance(target, str):
        one_target = sized(lookup.filter(F.col("_to") == target).drop("_to"))
        return df.join(one_target, source == F.col("_from"), "left").drop("_from"), F.lit(target)
    lookup = sized(lookup)
    on = (source == F.col("_from")) & (target == F.col("_to"))
    return df.join(lookup, on, "left").drop("_from", "_to"), target


def _amount_at_rate(amount: Column, source: Column, target: Column) -> Column:
    """Rounded to cents per row; NULL when the pair has no rate."""
    native = amount.cast(MONEY)
    return F.when(source == target, money(native)).otherwise(money(native * F.col("_rate")))


def convert(
    df: DataFrame,
    matrix: DataFrame,
    amount: str,
    source: str,
    target: Column | str,
    out: str = "amt",
) -> DataFrame:
    """Add ``out``: the amount in the target currency, rounded to cents per row.

    ``target`` is a column, or a currency code as text. A pair without a rate is an error;
    ``split_convertible`` sorts such rows out beforehand.
    """
    quoted, to = _quoted(df, matrix, F.col(source), target)
    value = _amount_at_rate(F.col(amount), F.col(source), to)
    missing = F.raise_error(
        F.concat(F.lit("no exchange rate for "), F.col(source), F.lit(" to "), to)
    ).cast("decimal(18,2)")
    checked = F.when(
        F.col("_rate").isNull() & (F.col(source) != to) & F.col(amount).isNotNull(), missing
    ).otherwise(value)
    return quoted.withColumn(out, checked).drop("_rate")


def split_convertible(
    df: DataFrame, matrix: DataFrame, source: str, target: Column | str
) -> tuple[DataFrame, DataFrame]:
    """(rows with a usable pair, rows without one)."""
    quoted, to = _quoted(df, matrix, F.col(source), target)
    usable = F.col("_rate").isNotNull() | (F.col(source) == to)
    return quoted.filter(usable).drop("_rate"), quoted.filter(~usable).drop("_rate")


def to_display(
    tx: DataFrame,
    matrix: DataFrame,
    currency: str | None = None,
    users: DataFrame | None = None,
) -> DataFrame:
    """Transactions with ``amt`` in the display currency: one code, or each user's base.

    Every row is converted once. For base currencies rows stay where they are if users are few
    or the user is frequent; others are shuffled by user (``skew.lookup_join``). Rows of users
    that the table lacks are left out.
    """
    if currency is not None:
        code = currency.upper()
        shown = convert(tx, matrix, "amount", "currency", code)
        return shown.withColumn("display_currency", F.lit(code))
    if users is None:
        raise ValueError("give a display currency or the users table")
    bases = users.select(
        F.col("id").alias("user_id"), F.upper("base_currency").alias("display_currency")
    )
    placed = lookup_join(tx, bases, ["user_id"], "inner", counted=users)
    return convert(placed, matrix, "amount", "currency", F.col("display_currency"))


# ----------------------------------------------------------------------------- rate history


def region_quotes(base: str) -> list[str]:
    return sorted(code for code in set(REGION_CURRENCY.values()) if code != base.upper())


def fx_points(
    history: DataFrame,
    base: str,
    start: Column | date | None,
    end: Column | date,
    max_days: int | None = None,
) -> DataFrame:
    """Stored rates of the region currencies in the range, one row per quote and day.

    The range is clamped only if ``max_days`` is given, as it is for loading from a rate service.
    """
    first, last = fx_range_bounds(start, end, max_days)
    return history.filter(
        (F.col("base_currency") == base.upper())
        & F.col("quote_currency").isin(region_quotes(base))
        & F.col("as_of").between(first, last)
    ).select("base_currency", "as_of", "quote_currency", "rate")


def fx_series(
    history: DataFrame,
    base: str,
    start: Column | date | None,
    end: Column | date,
    max_days: int | None = None,
) -> DataFrame:
    """One row per day with a quote-to-rate map, oldest first."""
    entry = F.struct("quote_currency", "rate")
    return (
        fx_points(history, base, start, end, max_days)
        .groupBy("as_of")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("rates"))
        .orderBy("as_of")
    )


def fx_coverage(
    history: DataFrame, requests: DataFrame, base: str = "base_currency"
) -> DataFrame:
    """Whether cached history answers each (base, start_on, end_on) request without a reload."""
    held = history.groupBy("base_currency").agg(
        F.min("as_of").alias("oldest"), F.max("as_of").alias("newest")
    )
    recent = F.datediff("end_on", "newest") <= 1
    return requests.join(
        held.withColumnRenamed("base_currency", base), base, "left"
    ).withColumn("covered", F.coalesce(recent & (F.col("oldest") <= F.col("start_on")), F.lit(False)))


def fx_day_move(history: DataFrame) -> DataFrame:
    """Change of each rate from its previous point: absolute and percent (0 after a 0 rate)."""
    line = Window.partitionBy(*PAIR).orderBy("as_of")
    before = F.col("previous_rate")
    move = F.col("rate") - before
    percent = F.when(
        before != 0, move.cast("double") / before.cast("double") * F.lit(100.0)
    ).otherwise(F.when(before.isNotNull(), F.lit(0.0)))
    return (
        history.select(*PAIR, "as_of", "rate")
        .withColumn("previous_rate", F.lag("rate").over(line))
        .withColumn("move", move.cast("decimal(19,8)"))
        .withColumn("move_percent", percent)
    )


def fx_latest_move(history: DataFrame) -> DataFrame:
    return top_k(fx_day_move(history), PAIR, [F.desc("as_of")], 1).drop("_rank")


# ----------------------------------------------------------------------------- rate updates


def upsert_fx_history(history: DataFrame, fetched: DataFrame) -> DataFrame:
    """History with fetched points (base, quote, as_of, rate, seq) merged in; the last one wins."""
    asked = fetched.withColumn("op", F.lit("upsert"))
    return merged_by_key(history, last_of_batch(history, asked, [*PAIR, "as_of"], ["rate"]))


def upsert_fx_current(current: DataFrame, fetched: DataFrame) -> DataFrame:
    """Current rates refreshed from each fetch's latest date only; an older fetch changes nothing."""
    last_day = fetched.groupBy("seq", "base_currency").agg(F.max("as_of").alias("as_of"))
    candidates = fetched.join(last_day, ["seq", "base_currency", "as_of"])
    # A stored rate loses a tie on the date. Of the fetched ones the latest date counts, then the
    # last fetch; so the order of a batch is by both.
    held = current.select(*PAIR, F.col("as_of").alias("_held"))
    asked = (
        candidates.join(held, PAIR, "left")
        .filter(F.col("_held").isNull() | (F.col("as_of") >= F.col("_held")))
        .withColumn("seq", F.unix_date("as_of") * F.lit(1 << 32) + F.col("seq"))
        .withColumn("op", F.lit("upsert"))
        .drop("_held")
    )
    return merged_by_key(current, last_of_batch(current, asked, PAIR, ["rate", "as_of"]))
