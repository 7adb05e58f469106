"""Calendar arithmetic as columns, so every row may carry its own anchor.

With literal anchors the expressions fold to constants and reach the scan as pushed filters.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

# Defaults and limits of the rate-history range, and the all-time fund date.
FX_DEFAULT_DAYS = 7
FX_MAX_DAYS = 365
ALL_TIME_START = date(1970, 1, 1)
MAX_SERIES_MONTHS = 36
DAYS_PER_MONTH = 30.44


def as_column(value: Column | str | date | None) -> Column:
    """Columns pass through; dates, strings and None become literals."""
    return value if isinstance(value, Column) else F.lit(value)


def as_day(value: Column | str | date | None) -> Column:
    return as_column(value).cast("date")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")


def month_of(year: Column, month: Column) -> Column:
    return F.make_date(year, month, F.lit(1))


def shift_months(year: Column, month: Column, delta: Column | int) -> tuple[Column, Column]:
    """(year, month) moved by ``delta`` months."""
    moved = F.add_months(month_of(year, month), as_column(delta))
    return F.year(moved), F.month(moved)


def time_range_bounds(name: Column | str, today: Column | date) -> tuple[Column, Column]:
    """Inclusive report bounds of a preset; NULLs for an open range. Year-to-date ends today."""
    preset, day = as_column(name), as_day(today)
    first = month_start(day)
    start = (
        F.when(preset == "this_month", first)
        .when(preset == "last_3m", F.add_months(first, -2))
        .when(preset == "ytd", F.trunc(day, "year"))
    )
    end = F.when(preset.isin("this_month", "last_3m"), F.last_day(day)).when(preset == "ytd", day)
    return start, end


def previous_range_bounds(name: Column | str, today: Column | date) -> tuple[Column, Column]:
    """The equally long range that ends the day before the preset's range."""
    start, end = time_range_bounds(name, today)
    before = F.date_sub(start, 1)
    return F.date_sub(before, F.datediff(end, start)), before


def months_for_range(name: Column | str, today: Column | date) -> Column:
    """Trailing months a monthly chart shows for a preset."""
    preset = as_column(name)
    return (
        F.when(preset == "this_month", 6)
        .when(preset == "last_3m", 3)
        .when(preset == "ytd", F.month(as_day(today)))
        .when(preset == "all", MAX_SERIES_MONTHS)
    )


def period_start(scope: Column | str, anchor: Column | date) -> Column:
    """First day of a budget scope; NULL for the all-time scope."""
    name, day = as_column(scope), as_day(anchor)
    first = month_start(day)
    return (
        F.when(name == "month", first)
        .when(name == "3m", F.add_months(first, -2))
        .when(name == "ytd", F.trunc(day, "year"))
    )


def period_end(scope: Column | str, anchor: Column | date) -> Column:
    """Day after the anchor's month (exclusive end); NULL for the all-time scope."""
    name, day = as_column(scope), as_day(anchor)
    return F.when(name.isin("month", "3m", "ytd"), F.add_months(month_start(day), 1))


def months_between(start: Column, end: Column) -> Column:
    """First days of the months in [start, end)."""
    return F.sequence(start, F.add_months(end, -1), F.expr("interval 1 month"))


def previous_period_end(scope: Column | str, anchor: Column | date) -> Column:
    """Last day before the scope's period; NULL for the all-time scope."""
    return F.date_sub(period_start(scope, anchor), 1)


def fund_period_start(scope: Column | str, anchor: Column | date) -> Column:
    return F.when(as_column(scope) == "all", F.lit(ALL_TIME_START)).otherwise(
        period_start(scope, anchor)
    )


def fx_range_bounds(
    start: Column | date | None, end: Column | date, max_days: int | None = FX_MAX_DAYS
) -> tuple[Column, Column]:
    """Last 7 days when no start is given; otherwise at most ``max_days`` back, if given."""
    first, last = as_day(start), as_day(end)
    clamped = first if max_days is None else F.greatest(first, F.date_sub(last, max_days))
    return F.when(first.isNull(), F.date_sub(last, FX_DEFAULT_DAYS - 1)).otherwise(clamped), last


def fx_preset_bounds(name: Column | str, today: Column | date) -> tuple[Column, Column]:
    """Rate-chart bounds of a preset: the all-time preset looks back 365 days."""
    start, end = time_range_bounds(name, today)
    open_range, day = as_column(name) == "all", as_day(today)
    return (
        F.when(open_range, F.date_sub(day, FX_MAX_DAYS)).otherwise(start),
        F.when(open_range, day).otherwise(end),
    )
