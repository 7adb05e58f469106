"""The registered queries: one per operator, over the ledger views."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from driver_queries.views import Views, views
from purseflow.functions import money as m, payroll_rules as rules, periods as p
from purseflow.operators import balances, budgets as b, changes as c, fx, insights, ledger as l
from purseflow.operators import payroll as pay, period_requests as asked, reports as r, rollup
from purseflow.plans import dashboards, rates
from purseflow.schemas import SCOPES, TABLES, TIME_RANGES
from purseflow.session import fresh_path, staged
from purseflow.sources import by_user, csv_export, fx_payloads, seeds, tables, versions

ANCHOR = date(1998, 6, 15)
MONEY = "decimal(18,2)"

Query = Callable[[Views], DataFrame]
_registry: dict[str, Query] = {}


def query(run: Query) -> Query:
    _registry[run.__name__] = run
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(run: Query) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: run(views(spark, sf_dir))

    return {name: bound(run) for name, run in _registry.items()}


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def usd(v: Views, tx: DataFrame | None = None) -> DataFrame:
    return fx.to_display(v.transactions if tx is None else tx, v.matrix, "USD")


def in_base(v: Views) -> DataFrame:
    return fx.to_display(v.transactions, v.matrix, users=v.users)


def category_totals(v: Views, **filters) -> DataFrame:
    tx = l.filter_transactions(v.transactions, **filters)
    return r.per_category_totals(usd(v, tx), v.categories)


def anchors(v: Views, name: str, values: tuple[str, ...]) -> DataFrame:
    """Every day with transactions, once per preset or scope."""
    days = v.transactions.select(F.col("occurred_on").alias("anchor")).distinct()
    return days.withColumn(name, F.explode(F.array(*[F.lit(x) for x in values])))


def paid_profiles(v: Views) -> DataFrame:
    return pay.with_breakdown(v.profiles)


def pick(df: DataFrame, *fields: str) -> DataFrame:
    """Breakdown fields next to the profile id."""
    return df.select("id", *[F.col(f"breakdown.{name}").alias(name) for name in fields])


# ------------------------------------------------------------------------ sources and sinks


def _dumped(v: Views, name: str) -> DataFrame:
    """A table as a database dumps it, with enum names."""
    scopes = F.create_map(
        *[F.lit(x) for x in ("month", "MONTH", "3m", "QUARTER", "ytd", "YTD", "all", "ALL")]
    )
    dumps = {
        "users": lambda: v.users,
        "transactions": lambda: v.transactions.withColumn("direction", F.upper("direction")),
        "categories": lambda: v.categories.withColumn("direction", F.upper("direction")),
        "budgets": lambda: v.budgets,
        "fund_overrides": lambda: v.fund_overrides.withColumn("scope", scopes[F.col("scope")]),
        "salary_profiles": lambda: v.profiles.withColumn("pay_period", F.upper("pay_period")),
        "exchange_rates": lambda: v.fx_history.filter("day(as_of) = 10"),
        "exchange_rate_history": lambda: v.fx_history,
        "jurisdictions": lambda: _jurisdictions(v),
    }
    return dumps[name]()


def _read_back(v: Views, name: str, fmt: str) -> DataFrame:
    """All columns of a table that was written and is read normalised."""
    root = fresh_path(v.spark, "ledger")
    tables.write_table(_dumped(v, name), root, name, fmt)
    read = tables.read_table(v.spark, root, name, fmt)
    return read.select(*TABLES[name].names)


@query
def s1_read_ledger(v: Views) -> DataFrame:
    return _read_back(v, "transactions", "parquet")


@query
def s1_read_users(v: Views) -> DataFrame:
    return _read_back(v, "users", "csv")


@query
def s1_read_categories(v: Views) -> DataFrame:
    return _read_back(v, "categories", "json")


@query
def s1_read_budgets(v: Views) -> DataFrame:
    return _read_back(v, "budgets", "orc")


@query
def s1_read_fund_overrides(v: Views) -> DataFrame:
    return _read_back(v, "fund_overrides", "csv")


@query
def s1_read_salary_profiles(v: Views) -> DataFrame:
    return _read_back(v, "salary_profiles", "parquet")


@query
def s1_read_exchange_rates(v: Views) -> DataFrame:
    return _read_back(v, "exchange_rates", "csv")


@query
def s1_read_exchange_rate_history(v: Views) -> DataFrame:
    return _read_back(v, "exchange_rate_history", "parquet")


@query
def s1_read_jurisdictions(v: Views) -> DataFrame:
    return _read_back(v, "jurisdictions", "json")


def _jurisdictions(v: Views) -> DataFrame:
    """Reference jurisdictions added to a table that holds regions of the users, all but two."""
    held = v.users.filter("default_region not in ('AU', 'EU')").groupBy("default_region").agg(
        F.min("id").alias("id"), F.max("base_currency").alias("currency")
    )
    own = held.selectExpr(
        "id", "default_region region", "'Own' name", "currency", "'own' modelled_as", "false supported"
    )
    return seeds.seed_jurisdictions(own)


@query
def s2_seed_jurisdictions(v: Views) -> DataFrame:
    return _jurisdictions(v)


@query
def s2_seed_rates(v: Views) -> DataFrame:
    """The missing USD rates next to the newest stored ones, which stay as they are."""
    latest = v.fx_history.filter("quote_currency <> 'AUD'").groupBy("base_currency", "quote_currency")
    held = latest.agg(F.max_by("rate", "as_of").alias("rate"), F.max("as_of").alias("as_of"))
    return seeds.seed_rates(held.withColumn("id", F.ascii("quote_currency").cast("bigint")), ANCHOR)


@query
def s2_seed_reference(v: Views) -> DataFrame:
    present = F.when(F.col("id") == 0, "Base salary").when(F.col("id") == 6, "Groceries")
    existing = v.categories.select(
        "id",
        F.coalesce(present, "name").alias("name"),
        "direction",
        "statutory",
        F.lit(None).cast("string").alias("region"),
        F.lit(False).alias("is_system"),
        F.lit(None).cast("bigint").alias("user_id"),
    )
    return seeds.seed_categories(existing)


@query
def s3_ingest_fx_payload(v: Views) -> DataFrame:
    """The history written as monthly payloads, next to malformed ones, and ingested again."""
    quotes = F.map_from_entries(F.collect_list(F.struct("quote_currency", "rate")))
    days = v.fx_history.groupBy("base_currency", "as_of").agg(quotes.alias("quotes"))
    per_month = days.groupBy(
        F.col("base_currency").alias("base"), F.trunc("as_of", "month").alias("month")
    ).agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.col("as_of").cast("string"), "quotes"))
        ).alias("rates")
    )
    good = per_month.select(fx_payloads.fx_payload_text(F.col("base"), F.col("rates")).alias("value"))
    bad_texts = [
        '{"nope": true}',
        "not json",
        '{"base": "USD", "rates": {"2024-02-01": {"PHP": 1.5}, "no-day": {"PHP": 2.5}}}',
        '{"base": "USD", "rates": {"2024-02-02": {"PHP": "x"}}}',
        '{"base": "USD", "rates": {"2024-2-1": {"PHP": 1.5}}}',
        '{"base": "USD", "rates": {"2024": {"PHP": 1.5}}}',
        # Good, but for days and quotes that it repeats: the last entries count.
        '{"base": "aud", "rates": {"2024-02-03": {"PHP": 1}, "2024-02-03": {"PHP": 2, "PHP": 3}}}',
    ]
    bad = per_month.select(F.explode(F.array(*[F.lit(t) for t in bad_texts])).alias("value"))
    path = fresh_path(v.spark, "fx-payloads")
    good.union(bad).write.text(path)
    return fx_payloads.read_fx_payloads(v.spark, path)


@query
def s4_export_expenses(v: Views) -> DataFrame:
    """Descriptions with quotes, blanks around, backslashes and line ends come back unchanged."""
    path = fresh_path(v.spark, "expenses")
    note = F.element_at(
        F.array(*[F.lit(t) for t in (None, "", "  padded  ", 'say "hi", now', "two\nlines", "a\\", '\\"x"')]),
        (F.col("id") % 7 + 1).cast("int"),
    )
    noted = v.transactions.withColumn("description", note)
    csv_export.export_expenses(noted, v.categories, path, v.matrix, "usd")
    columns = ["user_id", *csv_export.EXPENSE_COLUMNS, "amount_USD"]
    return csv_export.read_export(v.spark, path, columns)


@query
def s5_export_fx_history(v: Views) -> DataFrame:
    path = fresh_path(v.spark, "fx-history")
    csv_export.export_fx_history(v.fx_history, "usd", path)
    return csv_export.read_export(v.spark, path, list(csv_export.FX_COLUMNS))


@query
def s6_table_counts(v: Views) -> DataFrame:
    return tables.table_counts(
        {
            "users": v.users,
            "transactions": v.transactions,
            "categories": v.categories,
            "budgets": v.budgets,
            "fund_overrides": v.fund_overrides,
            "salary_profiles": v.profiles,
            "exchange_rates": seeds.reference_rates(v.spark),
            "exchange_rate_history": v.fx_history,
            "jurisdictions": _jurisdictions(v),
        }
    )


# -------------------------------------------------------------------------- filters, periods


@query
def f1_filter_tx(v: Views) -> DataFrame:
    rows = l.filter_transactions(v.transactions, "1998-01-01", "1998-06-30", "US")
    return rows.select("id", "user_id", "amount", "region", "occurred_on")


@query
def f2_filter_direction(v: Views) -> DataFrame:
    rows = l.filter_transactions(v.timed, direction="outbound")
    return rows.select("id", "user_id", "direction", "amount")


@query
def f3_list_transactions(v: Views) -> DataFrame:
    rows = l.list_transactions(v.timed, limit=10)
    return rows.select("user_id", "id", "occurred_on", "occurred_time", "position")


@query
def f4_list_categories(v: Views) -> DataFrame:
    return l.list_categories(v.categories, "outbound", include_statutory=False)


@query
def f5_resolve_currency(v: Views) -> DataFrame:
    rows = v.timed.join(
        v.users.select(F.col("id").alias("user_id"), "base_currency"), "user_id", "left"
    )
    slot = F.col("id") % 3
    given = F.when(slot == 0, F.lower("currency")).when(slot == 1, "")
    base = F.coalesce("base_currency", F.lit("USD"))
    return rows.select(
        "id",
        l.write_currency(given, F.col("region"), base).alias("write_currency"),
        l.read_currency(given, base).alias("read_currency"),
    )


@query
def f6_time_range_bounds(v: Views) -> DataFrame:
    rows = anchors(v, "range_name", TIME_RANGES)
    start, end = p.time_range_bounds(F.col("range_name"), F.col("anchor"))
    return rows.select("anchor", "range_name", start.alias("start_on"), end.alias("end_on"))


@query
def f7_previous_range_bounds(v: Views) -> DataFrame:
    rows = anchors(v, "range_name", TIME_RANGES)
    start, end = p.previous_range_bounds(F.col("range_name"), F.col("anchor"))
    return rows.select("anchor", "range_name", start.alias("start_on"), end.alias("end_on"))


@query
def f8_period_bounds(v: Views) -> DataFrame:
    return union(
        [
            b.period_bounds(v.users, v.budgets, scope, ANCHOR).withColumn("scope", F.lit(scope))
            for scope in SCOPES
        ]
    )


@query
def f9_previous_period_end(v: Views) -> DataFrame:
    rows = anchors(v, "scope", SCOPES)
    return rows.withColumn("previous_end", p.previous_period_end(F.col("scope"), F.col("anchor")))


@query
def f10_months_for_range(v: Views) -> DataFrame:
    rows = anchors(v, "range_name", TIME_RANGES)
    return rows.withColumn("months", p.months_for_range(F.col("range_name"), F.col("anchor")))


@query
def f11_fx_range_bounds(v: Views) -> DataFrame:
    days = v.transactions.select(F.col("occurred_on").alias("anchor")).distinct()
    slot = F.day("anchor") % 3
    asked = F.when(slot == 1, F.date_sub("anchor", 1000)).when(slot == 2, F.date_sub("anchor", 30))
    start, end = p.fx_range_bounds(asked, F.col("anchor"))
    return days.select("anchor", start.alias("start_on"), end.alias("end_on"))


@query
def f11_fx_preset_bounds(v: Views) -> DataFrame:
    rows = anchors(v, "range_name", TIME_RANGES)
    start, end = p.fx_preset_bounds(F.col("range_name"), F.col("anchor"))
    return rows.withColumn("start_on", start).withColumn("end_on", end)


@query
def f13_fund_period_start(v: Views) -> DataFrame:
    rows = anchors(v, "scope", SCOPES)
    return rows.withColumn("fund_start", p.fund_period_start(F.col("scope"), F.col("anchor")))


# ------------------------------------------------------------------------------------- joins


@query
def j1_with_category_name(v: Views) -> DataFrame:
    both = v.transactions.withColumn("ledger", F.lit("main")).unionByName(
        v.timed.withColumn("ledger", F.lit("timed"))
    )
    return l.with_category_name(both, v.categories).select("ledger", "id", "category_name")


@query
def j2_rate_matrix(v: Views) -> DataFrame:
    """Every pair out of the newest rate of each pair in the history."""
    pair = ["base_currency", "quote_currency"]
    newest = v.fx_history.groupBy(*pair).agg(F.max_by("rate", "as_of").alias("rate"))
    return fx.rate_matrix(newest)


@query
def j3_convert(v: Views) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in ("USD", "PHP", "AUD", "EUR")])
    rows = v.transactions.withColumn(
        "target", F.element_at(codes, (F.col("id") % 4 + 1).cast("int"))
    )
    done = fx.convert(rows, v.matrix, "amount", "currency", F.col("target"), "converted")
    return done.select("id", "amount", "currency", "target", "converted")


def _split(v: Views) -> tuple[DataFrame, DataFrame]:
    known = F.when(F.col("id") % 9 == 0, "JPY").otherwise(F.col("currency"))
    rows = v.transactions.withColumn("currency", known)
    target = F.when(F.col("id") % 27 == 0, "JPY").otherwise("USD")
    return fx.split_convertible(rows, v.matrix, "currency", target)


@query
def j3_split_convertible(v: Views) -> DataFrame:
    return union([part.select("id", "currency", F.lit(ok).alias("usable")) for part, ok in zip(_split(v), (True, False))])


@query
def j4_budget_spend(v: Views) -> DataFrame:
    limits = b.budget_limits(v.budgets, v.matrix, "ytd", ANCHOR)
    return b.budget_spend(limits, v.transactions, v.matrix, "ytd", ANCHOR)


@query
def j6_fund_status(v: Views) -> DataFrame:
    return b.fund_status(v.users, v.budgets, v.fund_overrides, in_base(v), SCOPES, ANCHOR)


def _by_user(v: Views) -> by_user.ByUser:
    return by_user.save_by_user(v.spark, v.users, v.transactions)


@query
def j3_base_amounts_by_user(v: Views) -> DataFrame:
    """Amounts in each user's currency, out of tables that lie in the same buckets."""
    return by_user.base_amounts(_by_user(v), v.matrix).select("id", "user_id", "display_currency", "amt")


@query
def j6_fund_status_by_user(v: Views) -> DataFrame:
    stored = _by_user(v)
    converted = by_user.base_amounts(stored, v.matrix)
    return b.fund_status(stored.users, v.budgets, v.fund_overrides, converted, SCOPES, ANCHOR)


@query
def j7_prior_period_delta(v: Views) -> DataFrame:
    now = category_totals(v, start="1998-04-01", end="1998-06-30")
    before = category_totals(v, start="1997-12-31", end="1998-03-31")
    return r.prior_period_delta(now, before).select(
        "user_id", "category_id", "category_name", "total", "previous_total", "change"
    )


@query
def j8_direction_mismatch(v: Views) -> DataFrame:
    other = F.when(F.col("direction") == "inbound", "outbound").otherwise("inbound")
    rows = v.transactions.withColumn(
        "direction", F.when(F.col("id") % 89 == 0, other).otherwise(F.col("direction"))
    ).withColumn(
        "amount", F.when(F.col("id") % 83 == 0, -F.col("amount")).otherwise(F.col("amount"))
    )
    return l.direction_rejects(rows, v.categories).select("id", "reason")


@query
def j9_budget_target_check(v: Views) -> DataFrame:
    slot = F.col("user_id") % 7
    rows = v.budgets.withColumn(
        "category_id", F.when(slot == 0, F.lit(0)).otherwise(F.col("category_id"))
    )
    rows = rows.withColumn("month", F.when(slot == 1, 13).otherwise(F.col("month"))).withColumn(
        "limit_amount",
        F.when(slot == 2, F.lit(0).cast("decimal(14,2)")).otherwise(F.col("limit_amount")),
    )
    return l.budget_rejects(rows, v.categories).select(
        "user_id", "category_id", "year", "month", "limit_amount", "reason"
    )


# ------------------------------------------------------------------------------ aggregations


@query
def a1_totals(v: Views) -> DataFrame:
    return r.totals(usd(v))


@query
def a2_per_category_totals(v: Views) -> DataFrame:
    return category_totals(v)


@query
def a3_top_expense_categories(v: Views) -> DataFrame:
    return r.top_expense_categories(category_totals(v), 3)


@query
def a4_monthly_totals(v: Views) -> DataFrame:
    return r.monthly_totals(usd(v), 6)


@query
def a5_monthly_expense_by_category(v: Views) -> DataFrame:
    return r.monthly_expense_by_category(usd(v), v.categories, 6)


@query
def a5_monthly_series(v: Views) -> DataFrame:
    """Aligned arrays per category, as text."""
    series = r.monthly_series(r.monthly_expense_by_category(usd(v), v.categories, 6))
    values = F.array_join(F.col("values").cast("array<string>"), ",")
    return series.withColumn("months", F.array_join("months", ",")).withColumn("values", values)


@query
def a6_top5_plus_other(v: Views) -> DataFrame:
    return r.top_plus_other(r.monthly_expense_by_category(usd(v), v.categories, 36))


@query
def a7_daily_totals(v: Views) -> DataFrame:
    return r.daily_totals(usd(v, v.timed))


def _status(v: Views, scope: str) -> DataFrame:
    return b.budget_status(v.budgets, v.transactions, v.categories, v.matrix, scope, ANCHOR)


@query
def a8_budget_status_month(v: Views) -> DataFrame:
    return b.budget_status(
        v.budgets, v.transactions, v.categories, v.matrix, year=ANCHOR.year, month=ANCHOR.month
    )


@query
def a8_budget_status_3m(v: Views) -> DataFrame:
    return _status(v, "3m")


@query
def a8_budget_status_ytd(v: Views) -> DataFrame:
    return _status(v, "ytd")


@query
def a8_budget_status_all(v: Views) -> DataFrame:
    return _status(v, "all")


def _all_scopes(v: Views) -> DataFrame:
    """Every user asks for all scopes at one anchor."""
    every = F.explode(F.array(*[F.lit(scope) for scope in SCOPES]))
    return v.users.select(
        F.col("id").alias("user_id"), every.alias("scope"), F.lit(ANCHOR).alias("anchor")
    )


def _requests(v: Views) -> DataFrame:
    """Every user asks for two scopes, at anchors of their own over three years."""
    name = lambda k: F.element_at(
        F.array(*[F.lit(scope) for scope in SCOPES]), ((F.col("id") + k) % 4 + 1).cast("int")
    )
    anchor = lambda k: F.add_months(F.lit(ANCHOR), (F.col("id") * (k + 1) % 36 - 24).cast("int"))
    pairs = [F.struct(name(k).alias("scope"), anchor(k).alias("anchor")) for k in (0, 1)]
    return v.users.select(F.col("id").alias("user_id"), F.inline(F.array(*pairs)))


@query
def a8_budget_status_scopes(v: Views) -> DataFrame:
    """All four scopes of the budget page from one read of transactions and budgets."""
    status = asked.budget_status_asked(_all_scopes(v), v.budgets, v.transactions, v.categories, v.matrix)
    return status.drop("anchor")


@query
def a8_budget_status_requests(v: Views) -> DataFrame:
    """Each user's own scopes and anchors in one job."""
    return asked.budget_status_asked(_requests(v), v.budgets, v.transactions, v.categories, v.matrix)


@query
def a10_budget_kpis_scopes(v: Views) -> DataFrame:
    """Key figures of every scope, out of one status table."""
    status = asked.budget_status_asked(_all_scopes(v), v.budgets, v.transactions, v.categories, v.matrix)
    return b.budget_kpis(status, ["scope", "user_id", "currency"])


@query
def a11_budget_projection_scopes(v: Views) -> DataFrame:
    status = asked.budget_status_asked(_all_scopes(v), v.budgets, v.transactions, v.categories, v.matrix)
    return b.budget_projection(status, ANCHOR, ["scope", "user_id", "currency"]).drop("period_start", "period_end")


@query
def j4_budget_spend_requests(v: Views) -> DataFrame:
    requests = _requests(v)
    held = asked.asked_budgets(requests, v.budgets)
    limits = asked.limits_asked(asked.asked_periods(requests, held), held, v.matrix)
    spend = asked.spend_asked(limits, v.transactions, v.matrix)
    return spend.select("user_id", "category_id", "scope", "anchor_month", "spent")


@query
def f8_period_requests(v: Views) -> DataFrame:
    return asked.asked_periods(_requests(v), v.budgets)


def _base_nets(v: Views) -> DataFrame:
    return balances.month_nets(in_base(v))


@query
def w6_carry_over_requests(v: Views) -> DataFrame:
    return asked.carry_over_asked(_requests(v), _base_nets(v))


@query
def j6_fund_status_requests(v: Views) -> DataFrame:
    return asked.fund_status_asked(_requests(v), v.users, v.budgets, v.fund_overrides, _base_nets(v))


@query
def w7_balance_with_fund_requests(v: Views) -> DataFrame:
    converted = in_base(v)
    funds = asked.fund_status_asked(
        _requests(v), v.users, v.budgets, v.fund_overrides, balances.month_nets(converted)
    )
    return asked.balance_with_fund_asked(_requests(v), converted, funds).select(
        "user_id", "scope", "anchor", "occurred_on", "net", "balance", "fund", "balance_with_fund"
    )


@query
def a10_budget_kpis(v: Views) -> DataFrame:
    return b.budget_kpis(_status(v, "ytd"))


@query
def a11_budget_projection(v: Views) -> DataFrame:
    return _projection(v, "3m")


@query
def a11_budget_projection_month(v: Views) -> DataFrame:
    return _projection(v, "month")


@query
def a11_budget_projection_ytd(v: Views) -> DataFrame:
    return _projection(v, "ytd")


def _projection(v: Views, scope: str) -> DataFrame:
    return b.budget_projection(_status(v, scope), ANCHOR).select(
        "user_id", "currency", "spent", "limit_amount", "elapsed_days", "total_days", "projected", "flagged"
    )


@query
def a12_savings_rate(v: Views) -> DataFrame:
    sums = r.totals(usd(v))
    return sums.select(
        "user_id",
        r.savings_rate(F.col("total_income"), F.col("total_expense")).alias("savings_rate"),
    )


def _snapshots(v: Views) -> DataFrame:
    """Active profiles with their stored figures."""
    return pay.profile_snapshot(pay.active_salary(v.profiles))


def _overview(v: Views) -> DataFrame:
    return dashboards.overview(
        v.users, v.transactions, v.categories, _snapshots(v), v.matrix, chosen=True,
        start="1998-01-01", end="1998-12-31",
    )


@query
def a13_overview(v: Views) -> DataFrame:
    return _overview(v).drop("categories")


@query
def a13_overview_by_user(v: Views) -> DataFrame:
    """The overview out of tables that lie in the same buckets of the user."""
    stored = _by_user(v)
    year = l.filter_transactions(by_user.base_amounts(stored, v.matrix), "1998-01-01", "1998-12-31")
    found = dashboards.user_summary(
        stored.users, year, v.categories, _snapshots(v), v.matrix, chosen=True
    )
    return found.drop("categories")


@query
def a13_overview_categories(v: Views) -> DataFrame:
    return _overview(v).select("user_id", F.inline("categories"))


@query
def a14_dashboard_summary(v: Views) -> DataFrame:
    """The nested lists as text: finding keys, and id:total of the top categories."""
    summary = dashboards.dashboard(
        v.users, v.transactions, v.categories, _snapshots(v), v.matrix, chosen=True,
        start="1998-04-01", end="1998-06-30",
    )
    top = F.transform(
        "top_expense_categories",
        lambda x: F.concat_ws(":", x["category_id"].cast("string"), x["total"].cast("string")),
    )
    return summary.withColumn(
        "top_categories", F.array_join(top, ",")
    ).withColumn("top_count", F.size("top_expense_categories")).withColumn("insights", F.array_join("insights.key", ",")).drop("top_expense_categories")


@query
def a14_report_page(v: Views) -> DataFrame:
    """Ten reports out of one rollup, as (report, user, label, value); rows are read once."""
    daily = rollup.daily_rollup(usd(v))
    monthly = rollup.monthly_rollup(daily)
    by_category = r.per_category_totals(monthly, v.categories)
    shared = r.monthly_expenses(monthly)
    grid = r.monthly_expense_by_category(monthly, v.categories, 6, shared)
    top = r.top_plus_other(r.monthly_expense_by_category(monthly, v.categories, 36, shared))
    start, end = p.time_range_bounds("ytd", ANCHOR)
    spent = r.totals(l.filter_transactions(daily, start, end))
    burn = F.round(r.burn_rate(F.col("total_expense"), start, end)["per_month"], 2)
    people = dashboards.user_summary(
        v.users, monthly, v.categories, _snapshots(v), v.matrix, "USD", chosen=True
    )
    found = insights.insights(dashboards.insight_summary(people))
    flows = lambda names: F.inline(
        F.array(*[F.struct(F.lit(n).alias("label"), F.col(n).alias("value")) for n in names])
    )
    text = lambda *names: F.concat_ws("/", *[F.col(n).cast("string") for n in names]).alias("label")
    value = lambda name: F.col(name).cast(MONEY).alias("value")
    months = r.monthly_totals(monthly, 6)
    reports = {
        "a1": r.totals(monthly).select("user_id", flows(["total_income", "total_expense", "net_cashflow"])),
        "a2": by_category.select("user_id", text("category_id", "direction"), value("total")),
        "a3": r.top_expense_categories(by_category, 3).select("user_id", text("rank", "category_id"), value("total")),
        "a4": months.select("user_id", text("month"), value("net")),
        "a5": grid.select("user_id", text("category_id", "month"), value("value")),
        "a6": top.select("user_id", text("label", "month"), value("value")),
        "a7": r.daily_totals(daily).select("user_id", text("occurred_on"), value("net")),
        "a15": spent.select("user_id", F.lit("per_month").alias("label"), burn.cast(MONEY).alias("value")),
        "a16": r.statutory_split(by_category, v.categories).select("user_id", text("statutory"), value("total")),
        "i1": found.select("user_id", text("position", "key", "detail"), F.lit(0).cast(MONEY).alias("value")),
    }
    return union([df.withColumn("report", F.lit(name)) for name, df in reports.items()])


@query
def a15_burn_rate(v: Views) -> DataFrame:
    start, end = p.time_range_bounds("ytd", ANCHOR)
    sums = r.totals(usd(v, l.filter_transactions(v.transactions, start, end)))
    rates = sums.withColumn("_burn", r.burn_rate(F.col("total_expense"), start, end))
    return rates.select("user_id", "total_expense", "_burn.*")


@query
def a16_statutory_split(v: Views) -> DataFrame:
    return r.statutory_split(category_totals(v), v.categories)


@query
def a17_distinct_budget_months(v: Views) -> DataFrame:
    return b.budget_months(v.budgets)


# ----------------------------------------------------------------------------------- windows


@query
def w1_running_balance(v: Views) -> DataFrame:
    return r.running_balance(usd(v))


@query
def w2_running_balance_by_transaction(v: Views) -> DataFrame:
    return l.running_balance_by_transaction(usd(v, v.timed)).select("id", "user_id", "balance")


@query
def w3_expense_deltas(v: Views) -> DataFrame:
    return l.expense_deltas(v.timed).select("user_id", "id", "amount", "delta")


@query
def w4_fx_day_move(v: Views) -> DataFrame:
    return fx.fx_day_move(v.fx_history)


@query
def w4_fx_latest_move(v: Views) -> DataFrame:
    return fx.fx_latest_move(v.fx_history)


@query
def w5_active_salary(v: Views) -> DataFrame:
    return pay.active_salary(v.profiles)


@query
def w6_carry_over_fund(v: Views) -> DataFrame:
    return b.carry_over_funds(v.users, in_base(v), ["3m", "ytd"], ANCHOR)


@query
def w7_balance_with_fund(v: Views) -> DataFrame:
    converted = usd(v)
    funds = b.fund_status(
        v.users, v.budgets, v.fund_overrides, converted, ["ytd"], ANCHOR, "USD"
    )
    return b.balance_with_fund(converted, funds, "ytd", ANCHOR).select(
        "user_id", "occurred_on", "net", "balance", "balance_with_fund"
    )


@query
def w8_last_balance(v: Views) -> DataFrame:
    return r.last_balances(v.users, usd(v), date(1998, 4, 1), date(1998, 6, 30))


@query
def w9_ledger_view(v: Views) -> DataFrame:
    view = l.ledger_view(usd(v, v.timed), v.categories, limit=25, start="2024-01-08")
    return view.select("user_id", "position", "id", "category_name", "amt", "balance")


def _kept_balances(v: Views) -> tuple[DataFrame, DataFrame]:
    """(the rows after a batch, with month folders; the nets kept up by the batch's differences)."""
    root, before, after, _ = _versioned(v)
    months = versions.changed_months(before, after)
    old, new = (versions.rows_of(v.spark, root, x) for x in (before, after))
    nets = staged(balances.month_nets(usd(v, old)), "nets")
    # Only the months that the batch rewrote are read again.
    changed = [usd(v, versions.in_months(rows, months)) for rows in (old, new)]
    return new, staged(balances.updated_nets(nets, balances.net_differences(*changed)), "nets")


@query
def w8_month_balances(v: Views) -> DataFrame:
    """Month-end balances after a batch, brought up to date by its signed differences."""
    return balances.month_balances(_kept_balances(v)[1])


@query
def w1_running_balance_kept(v: Views) -> DataFrame:
    new, nets = _kept_balances(v)
    return balances.running_balance_kept(nets, usd(v, new), "1997-03-10", "1997-06-20").select(
        "user_id", "occurred_on", "net", "balance"
    )


@query
def w2_transaction_balance_kept(v: Views) -> DataFrame:
    new, nets = _kept_balances(v)
    rows = balances.transaction_balance_kept(nets, usd(v, new), "1997-03-10", "1997-06-20")
    return rows.select("user_id", "id", "balance")


@query
def w8_balance_at_kept(v: Views) -> DataFrame:
    new, nets = _kept_balances(v)
    return balances.balance_at_kept(nets, usd(v, new), "1997-05-17")


@query
def f3_newest_by_month(v: Views) -> DataFrame:
    """The five newest rows of a third of the users, from the months that hold them."""
    nets = balances.month_nets(usd(v))
    some = v.users.filter("id % 3 = 0").select(F.col("id").alias("user_id"))
    rows = balances.newest_transactions(nets, v.transactions, 5, some)
    return rows.select("user_id", "position", "id", "occurred_on")


# --------------------------------------------------------------------------- scalar functions


@query
def x1_money(v: Views) -> DataFrame:
    scaled = F.col("amount") * F.lit("0.335").cast("decimal(4,3)")
    return v.transactions.select("id", m.money(scaled).alias("value"), m.money(-scaled).alias("negated"))


@query
def x2_month_key(v: Views) -> DataFrame:
    months = v.transactions.groupBy(p.month_key(F.col("occurred_on")).alias("month"))
    return months.agg(F.count(F.lit(1)).alias("n"))


@query
def x3_add_months(v: Views) -> DataFrame:
    days = v.transactions.select(F.col("occurred_on").alias("anchor")).distinct()
    day = F.col("anchor")
    back = p.shift_months(F.year(day), F.month(day), -14)
    ahead = p.shift_months(F.year(day), F.month(day), F.day(day))
    return days.select(
        "anchor",
        back[0].alias("back_year"),
        back[1].alias("back_month"),
        ahead[0].alias("ahead_year"),
        ahead[1].alias("ahead_month"),
    )


def _shares(v: Views) -> DataFrame:
    """Every expense category of each user next to the user's expenses, from one aggregation."""
    whole = F.sum("total").over(Window.partitionBy("user_id"))
    expenses = category_totals(v).filter("direction = 'outbound'")
    return expenses.withColumn("total_expense", whole.cast("decimal(18,2)"))


@query
def x4_ratio(v: Views) -> DataFrame:
    share = (F.col("total"), F.col("total_expense"))
    return _shares(v).select(
        "user_id", "category_id", m.ratio(*share, 4).alias("share4"), m.ratio(*share, 2).alias("share2")
    )


@query
def x5_percent_text(v: Views) -> DataFrame:
    share = m.ratio(F.col("total"), F.col("total_expense"), 2)
    return _shares(v).select("user_id", "category_id", m.percent_text(share).alias("share"))


@query
def x9_amount_text(v: Views) -> DataFrame:
    """Every amount of odd cents lies halfway between two rates."""
    small = F.col("amount") * F.lit("0.00005").cast("decimal(6,5)")
    return v.transactions.select(
        "id", m.amount_text(F.col("amount")).alias("amount"), m.amount_text(small, 6).alias("rate")
    )


@query
def x10_currency_code(v: Views) -> DataFrame:
    return v.timed.select("id", m.currency_code(F.lower("currency")).alias("currency"))


# ----------------------------------------------------------------------------------- payroll


@query
def p1_progressive_tax(v: Views) -> DataFrame:
    brackets = [("0", "0"), ("1000", "0.10"), ("200000", "0.20")]
    tax = rules.progressive_tax(F.col("gross_amount"), brackets)
    return v.profiles.select("id", m.money(tax).alias("tax"))


@query
def p2_capped_contribution(v: Views) -> DataFrame:
    due = rules.capped_contribution(F.col("gross_amount"), "0.045", "48000", "360000")
    return v.profiles.select("id", m.money(due).alias("contribution"))


@query
def p3_annualize(v: Views) -> DataFrame:
    annual = pay.annualize(F.col("gross_amount"), F.col("pay_period"))
    return v.profiles.select("id", annual.alias("gross_annual"))


RULE_FIELDS = ("gross_annual", "total_tax", "total_social", "total_deductions", "net_annual")


def _region(v: Views, region: str) -> DataFrame:
    only = v.profiles.filter(F.col("region") == region)
    return pick(pay.with_breakdown(only, {region: rules.RULES[region]}), *RULE_FIELDS)


@query
def p4_ph_rule(v: Views) -> DataFrame:
    return _region(v, "PH")


@query
def p5_us_rule(v: Views) -> DataFrame:
    return _region(v, "US")


@query
def p6_au_rule(v: Views) -> DataFrame:
    return _region(v, "AU")


@query
def p7_eu_rule(v: Views) -> DataFrame:
    return _region(v, "EU")


@query
def p8_breakdown(v: Views) -> DataFrame:
    return pick(
        paid_profiles(v),
        "region",
        "currency",
        "tax_year",
        "pay_period",
        *RULE_FIELDS,
        "gross_period",
        "net_period",
        "effective_rate",
    )


def _with_unknown(v: Views) -> DataFrame:
    unknown = F.when(F.col("id") % 41 == 0, "ZZ").otherwise(F.col("region"))
    return v.profiles.withColumn("region", unknown)


@query
def p9_payroll_run(v: Views) -> DataFrame:
    paid, rejected = pay.payroll_run(_with_unknown(v))
    return paid.select(
        "id", F.col("breakdown.net_annual").alias("net_annual"), F.lit(None).cast("string").alias("reason")
    ).unionByName(rejected.select("id", F.lit(None).cast(MONEY).alias("net_annual"), "reason"))


@query
def p10_payroll_items(v: Views) -> DataFrame:
    return pay.payroll_items(paid_profiles(v), "period").select(
        "profile_id", "key", "label", "kind", "amount"
    )


@query
def p11_payroll_register(v: Views) -> DataFrame:
    return pay.payroll_register(paid_profiles(v))


@query
def p12_rule_registry(v: Views) -> DataFrame:
    """A fifth region registered next to the built-in ones, and the profiles of each."""
    extended = rules.with_rule(rules.PayrollRule("ZZ", "USD", "Flat tenth", brackets=(("0", "0.10"),)))
    paid = pay.with_breakdown(_with_unknown(v), extended)
    sums = paid.groupBy("region").agg(
        F.count(F.lit(1)).alias("profiles"),
        F.sum("breakdown.total_tax").cast("decimal(24,2)").alias("total_tax"),
    )
    return pay.region_info(v.spark, extended).join(sums, "region", "left")


@query
def p13_profile_snapshot(v: Views) -> DataFrame:
    stored = pay.profile_snapshot(v.profiles)
    text = pay.breakdown_json(F.col("breakdown"))
    return stored.select(
        "id",
        "currency",
        "tax_year",
        F.col("net_amount").cast(MONEY).alias("net_amount"),
        F.col("total_deductions").cast(MONEY).alias("total_deductions"),
        F.get_json_object(text, "$.net_period").alias("net_period_text"),
    )


@query
def i1_insights(v: Views) -> DataFrame:
    base = dashboards.overview(
        v.users, v.transactions, v.categories, _snapshots(v), v.matrix, "USD", chosen=True
    )
    return insights.insights(dashboards.insight_summary(base))


# ----------------------------------------------------------------------------------- changes


def _tx_base(v: Views) -> DataFrame:
    return v.transactions.withColumn("description", F.lit(None).cast("string"))


def _change(df: DataFrame, op: str, seq: Column, fields: list[str], **values: Column) -> DataFrame:
    named = F.array(*[F.lit(f) for f in fields]).cast("array<string>")
    out = df.withColumn("op", F.lit(op)).withColumn("seq", seq).withColumn("fields", named)
    return out.withColumns(values) if values else out


def _tx_inserts(v: Views) -> DataFrame:
    rows = _tx_base(v).filter("id % 101 = 0")
    other = F.when(F.col("direction") == "inbound", "outbound").otherwise("inbound")
    slot = F.col("id") % 3
    return _change(
        rows,
        "insert",
        F.col("id") * 10,
        [],
        direction=F.when(F.col("id") % 303 == 0, other).otherwise(F.col("direction")),
        amount=F.when(F.col("id") % 707 == 0, -F.col("amount")).otherwise(F.col("amount")),
        currency=F.when(slot == 0, F.lower("currency")).when(slot == 1, ""),
        region=F.when(slot == 2, F.col("region")),
        description=F.lit("new"),
        id=F.col("id") + 1_000_000_000,
    )


def _variants(df: DataFrame, *rows: tuple[Column, dict[str, Column]]) -> DataFrame:
    """Change rows out of one pass over df: a copy with the given values per true condition."""
    names = list(dict.fromkeys([*df.columns, *[n for _, values in rows for n in values]]))
    kinds = dict(df.dtypes)

    def entry(values: dict[str, Column]) -> Column:
        cells = []
        for name in names:
            cell = values.get(name, F.col(name) if name in kinds else F.lit(None))
            cells.append((cell.cast(kinds[name]) if name in kinds else cell).alias(name))
        return F.struct(*cells)

    picked = F.array_compact(F.array(*[F.when(cond, entry(values)) for cond, values in rows]))
    return df.select(F.inline(picked))


def _names(*fields: str) -> Column:
    return F.array(*[F.lit(name) for name in fields]).cast("array<string>")


def _tx_edits(v: Views, *ops: str) -> DataFrame:
    key, user = F.col("id"), F.col("user_id")
    patch, delete = F.lit("patch"), F.lit("delete")
    rows = {
        "patch": [
            (
                key % 50 == 0,
                {
                    "op": patch,
                    "seq": key * 10 + 1,
                    "fields": _names("amount", "occurred_time"),
                    "amount": F.col("amount") + 1,
                    "occurred_time": F.lit("08:00:00"),
                    "user_id": F.when(key % 150 == 0, user + 1).otherwise(user),
                },
            ),
            (
                key % 100 == 0,
                {
                    "op": patch,
                    "seq": key * 10 + 2,
                    "fields": _names("category_id", "occurred_time", "currency"),
                    "category_id": F.lit(9),
                    "occurred_time": F.lit(None),
                    "currency": F.lit("eur"),
                },
            ),
        ],
        "delete": [
            (key % 97 == 0, {"op": delete, "seq": key * 10 + 3, "fields": _names()}),
            (key % 194 == 0, {"op": delete, "seq": key * 10 + 4, "fields": _names()}),
        ],
    }
    return _variants(_tx_base(v), *[row for op in ops for row in rows[op]])


def _merged(v: Views, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return c.apply_transactions(_tx_base(v), changes, v.categories, v.users)


TX_COLUMNS = ("id", "user_id", "direction", "category_id", "amount", "currency", "region")


@query
def u1_insert_transactions(v: Views) -> DataFrame:
    table, _ = _merged(v, _tx_inserts(v))
    return table.select(*TX_COLUMNS, "description")


@query
def u1_insert_rejects(v: Views) -> DataFrame:
    _, rejected = _merged(v, _tx_inserts(v))
    return rejected.select("seq", "id", "reason")


@query
def u2_patch_transactions(v: Views) -> DataFrame:
    table, _ = _merged(v, _tx_edits(v, "patch"))
    return table.select(*TX_COLUMNS, "occurred_time")


@query
def u3_delete_transactions(v: Views) -> DataFrame:
    """Inserts, patches and deletes in one batch."""
    table, _ = _merged(v, _tx_inserts(v).unionByName(_tx_edits(v, "patch", "delete")))
    return table.select(*TX_COLUMNS, "occurred_time")


@query
def u3_delete_rejects(v: Views) -> DataFrame:
    _, rejected = _merged(v, _tx_edits(v, "patch", "delete"))
    return rejected.select("seq", "op", "id", "reason")


def _versioned(v: Views) -> tuple[str, versions.Version, versions.Version, DataFrame]:
    """The transactions as a table of versions, and a batch that touches two months of it."""
    root = fresh_path(v.spark, "versions")
    versions.create_versions(_tx_base(v), root)
    batch = _tx_inserts(v).unionByName(_tx_edits(v, "patch", "delete"))
    batch = batch.filter(F.trunc("occurred_on", "month").isin(date(1997, 3, 1), date(1997, 5, 1)))
    return root, *versions.apply_batch(v.spark, root, batch, v.categories, v.users)


@query
def u1_versioned_ledger(v: Views) -> DataFrame:
    """The version after a batch; months that the batch left alone keep their files."""
    root, before, after, _ = _versioned(v)
    month = versions.month_name(F.col("occurred_on"))
    rewritten = month.isin(versions.changed_months(before, after))
    rows = versions.rows_of(v.spark, root, after)
    return rows.select(*TX_COLUMNS, "occurred_time", rewritten.alias("rewritten"))


@query
def u1_version_before(v: Views) -> DataFrame:
    """The version that readers of the old number still see."""
    root, before, _, _ = _versioned(v)
    return versions.read_version(v.spark, root, before.number).select(*TX_COLUMNS, "occurred_time")


@query
def u1_version_rejects(v: Views) -> DataFrame:
    return _versioned(v)[3].select("seq", "op", "id", "reason")


def _budget_changes(v: Views) -> DataFrame:
    first = F.expr("((user_id * 100 + category_id) * 10000L + year) * 1000 + month * 10")
    slot, month = F.col("user_id") + F.col("month"), F.col("month")
    return _variants(
        v.budgets,
        (
            slot % 5 == 0,
            {
                "op": F.lit("upsert"),
                "seq": first,
                "limit_amount": F.col("limit_amount") + 10,
                "currency": F.when(month % 2 == 1, F.lower("currency")),
            },
        ),
        (slot % 7 == 0, {"op": F.lit("delete"), "seq": first + 1}),
        (slot % 11 == 0, {"op": F.lit("delete"), "seq": first + 2}),
        (
            slot % 13 == 0,
            {"op": F.lit("upsert"), "seq": first + 3, "category_id": F.lit(0)},
        ),
    )


@query
def u4_upsert_budgets(v: Views) -> DataFrame:
    """Ids stay with their rows, also where limits change; new rows bring their own."""
    key = F.expr("user_id * 10000000L + category_id * 100000L + year * 20 + month")
    base = v.budgets.filter("(user_id + category_id) % 4 <> 0").withColumn("id", key)
    changes = _budget_changes(v).withColumn("id", key + F.lit(10**12) + F.col("seq") % 10)
    return c.apply_budgets(base, changes, v.categories, v.users)[0]


@query
def u4_budget_rejects(v: Views) -> DataFrame:
    rejected = c.apply_budgets(v.budgets, _budget_changes(v), v.categories, v.users)[1]
    return rejected.select("seq", "op", "reason")


@query
def u4_delete_budgets_by_id(v: Views) -> DataFrame:
    """Kept ids and rejected requests: others' budgets, repeated deletes and unknown ids."""
    key = F.expr("user_id * 10000000L + category_id * 100000L + year * 20 + month")
    base = v.budgets.withColumn("id", key)
    asked = _variants(
        base.select("id", "user_id"),
        (key_mod("id", 5), {"seq": F.col("id") * 4}),
        (key_mod("id", 15), {"seq": F.col("id") * 4 + 1}),
        (key_mod("id", 7), {"seq": F.col("id") * 4 + 2, "user_id": F.col("user_id") + 1}),
        (key_mod("id", 11), {"seq": F.col("id") * 4 + 3, "id": -F.col("id") - 1}),
    )
    kept, rejected = c.delete_budgets(base, asked)
    return kept.select("id", F.lit("").alias("reason")).union(rejected.select("seq", "reason"))


def key_mod(name: str, slot: int) -> Column:
    return F.col(name) % slot == 0


def _funds_by_anchor(v: Views) -> tuple[DataFrame, DataFrame]:
    day = F.make_date(F.lit(1998), (F.col("id") % 12 + 1).cast("int"), F.lit(15))
    scopes = F.array(*[F.lit(x) for x in ("month", "3m", "ytd", "all", "week")])
    asked = v.users.filter("id % 3 = 0").select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 33 == 0, "reset").otherwise("upsert").alias("op"),
        F.when(F.col("id") % 21 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("user_id"),
        F.element_at(scopes, (F.col("id") % 5 + 1).cast("int")).alias("scope"),
        day.alias("anchor"),
        F.col("id").cast("decimal(14,2)").alias("amount"),
        F.lit(None).cast("string").alias("currency"),
    )
    return c.apply_funds_by_anchor(v.fund_overrides, asked, v.users)


@query
def u5_fund_by_anchor(v: Views) -> DataFrame:
    return _funds_by_anchor(v)[0]


@query
def u5_fund_by_anchor_rejects(v: Views) -> DataFrame:
    return _funds_by_anchor(v)[1].select("seq", "reason")


@query
def u5_upsert_fund_overrides(v: Views) -> DataFrame:
    """Raised amounts, resets of some, and new overrides for users that had none."""
    made = F.make_date(F.lit(2020), F.lit(1), F.lit(1)) + (F.col("user_id") % 300).cast("int")
    rows = v.fund_overrides.withColumn("id", F.col("user_id") * 7)
    rows = rows.withColumn("created_at", made).withColumn("updated_at", made)
    raised = rows.filter("user_id % 20 = 0").select(
        (F.col("user_id") * 10).alias("seq"),
        F.lit("upsert").alias("op"),
        "user_id",
        "scope",
        "period_start",
        (F.col("amount") + 5).cast("decimal(14,2)").alias("amount"),
        F.lit(None).cast("string").alias("currency"),
    )
    resets = rows.filter("user_id % 60 = 0").select(
        (F.col("user_id") * 10 + 1).alias("seq"),
        F.lit("reset").alias("op"),
        "user_id",
        "scope",
        "period_start",
        "amount",
        "currency",
    )
    fresh = v.users.filter("id % 10 = 3").select(
        (F.col("id") * 10).alias("seq"),
        F.lit("upsert").alias("op"),
        F.col("id").alias("user_id"),
        F.lit("all").alias("scope"),
        F.lit(p.ALL_TIME_START).alias("period_start"),
        F.lit(100).cast("decimal(14,2)").alias("amount"),
        F.lit("aud").alias("currency"),
    )
    now = F.lit(date(2026, 6, 15))
    changes = (
        union([raised, resets, fresh])
        .withColumn("id", F.col("user_id") * 7 + 3)
        .withColumn("created_at", now)
        .withColumn("updated_at", now)
    )
    return c.apply_fund_overrides(rows, changes, v.users)


@query
def u6_activate_profile(v: Views) -> DataFrame:
    base = v.profiles.select("id", "user_id", "is_active", "updated_at")
    at = F.expr("timestamp_ntz'2002-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq % 100000)")
    created = (
        base.filter("id % 53 = 0")
        .withColumn("seq", F.col("id") * 10)
        .withColumn("is_active", F.col("id") % 2 == 0)
        .withColumn("updated_at", at)
        .withColumn("id", F.col("id") + 1_000_000_000)
    )
    actions = union(
        [
            base.filter("id % 59 = 0").selectExpr("id * 10 + 1 seq", "'activate' op", "id", "user_id"),
            base.filter("id % 61 = 0").selectExpr("id * 10 + 2 seq", "'delete' op", "id", "user_id"),
        ]
    ).withColumn("at", at)
    return c.apply_profiles(base, created, actions)[0]


def _created_profiles(v: Views) -> tuple[DataFrame, DataFrame]:
    """A new profile for every 67th stored one, from its input; some with bad regions or pay."""
    none = F.lit(None).cast("decimal(14,2)")
    base = v.profiles.withColumn("net_amount", none).withColumn("total_deductions", none)
    slot = F.col("id") % 7
    asked = v.profiles.filter("id % 67 = 0").select(
        (F.col("id") * 2).alias("seq"),
        (F.col("id") + 2_000_000_000).alias("id"),
        "user_id",
        F.when(slot == 1, "XX").otherwise(F.col("region")).alias("region"),
        F.when(slot == 2, -F.col("gross_amount")).otherwise(F.col("gross_amount")).alias("gross_amount"),
        "pay_period",
        "tax_year",
        (F.col("id") % 2 == 0).alias("make_active"),
        F.expr("timestamp_ntz'2003-01-01 00:00:00'").alias("at"),
    )
    return c.create_profiles(base, asked)


@query
def u6_create_profiles(v: Views) -> DataFrame:
    return _created_profiles(v)[0].select(
        "id", "user_id", "region", "currency", "net_amount", "total_deductions", "is_active"
    )


@query
def u6_create_rejects(v: Views) -> DataFrame:
    return _created_profiles(v)[1].select("seq", "reason")


@query
def u6_profile_rejects(v: Views) -> DataFrame:
    """Activations of others' profiles and repeated deletes."""
    base = v.profiles.select("id", "user_id", "is_active", "updated_at")
    at = F.expr("timestamp_ntz'2002-01-01 00:00:00'")
    actions = _variants(
        base.select("id", "user_id"),
        (key_mod("id", 59), {"seq": F.col("id") * 4, "op": F.lit("activate"), "user_id": F.col("user_id") + 1}),
        (key_mod("id", 61), {"seq": F.col("id") * 4 + 1, "op": F.lit("delete")}),
        (key_mod("id", 61), {"seq": F.col("id") * 4 + 2, "op": F.lit("delete")}),
        (key_mod("id", 67), {"seq": F.col("id") * 4 + 3, "op": F.lit("activate")}),
    ).withColumn("at", at)
    none = base.limit(0).withColumn("seq", F.lit(0).cast("bigint"))
    return c.apply_profiles(base, none, actions)[1].select("seq", "op", "reason")


def _category_changes(v: Views) -> tuple[DataFrame, DataFrame]:
    base = v.categories.select(
        "id",
        "name",
        "direction",
        "statutory",
        F.lit(None).cast("string").alias("region"),
        F.lit(True).alias("is_system"),
        F.lit(None).cast("bigint").alias("user_id"),
    )
    changes = v.users.filter("id % 10 = 0").select(
        F.col("id").alias("seq"),
        (F.col("id") + 1000).cast("int").alias("id"),
        F.when(F.col("id") % 70 == 0, "CAT_6")
        .otherwise(F.concat(F.lit("USR_"), (F.col("id") % 300).cast("string")))
        .alias("name"),
        F.when(F.col("id") % 40 == 0, "inbound").otherwise("outbound").alias("direction"),
        F.col("id").alias("user_id"),
    )
    return c.add_categories(base, changes)


@query
def u7_add_categories(v: Views) -> DataFrame:
    return _category_changes(v)[0]


@query
def u7_category_rejects(v: Views) -> DataFrame:
    return _category_changes(v)[1].select("seq", "name", "direction", "reason")


@query
def u8_update_users(v: Views) -> DataFrame:
    base = v.users.withColumn("email", F.concat(F.lit("u"), F.col("id").cast("string")))
    none = F.lit(None).cast("string")

    def patch(slot: int, step: int, fields: list[str], **values: Column) -> DataFrame:
        unset = {n: none for n in c.USER_FIELDS}
        rows = base.filter(F.col("id") % slot == 0).select("id")
        return _change(rows, "patch", F.col("id") * 10 + step, fields, **{**unset, **values})

    changes = union(
        [
            patch(9, 1, ["base_currency"], base_currency=F.lit("EUR")),
            patch(18, 2, ["name", "email"], name=F.lit("renamed")),
            patch(27, 3, ["base_currency", "default_region"], base_currency=F.lit("AUD"), default_region=F.lit("AU")),
        ]
    )
    return c.update_users(base, changes)[0]


@query
def u8_user_rejects(v: Views) -> DataFrame:
    asked = v.users.filter("id % 30 = 0").select(
        F.when(F.col("id") % 60 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("id"),
        "name",
        F.lit(None).cast("string").alias("email"),
        "base_currency",
        "default_region",
    )
    changes = _change(asked, "patch", F.abs("id"), ["name"])
    return c.update_users(v.users.withColumn("email", F.lit(None).cast("string")), changes)[1].select(
        "seq", "id", "reason"
    )


@query
def u8_default_user(v: Views) -> DataFrame:
    """The users of a region without any, and those of one with some."""
    empty = c.default_user_if_none(v.users.filter("default_region = 'XX'"))
    return empty.union(c.default_user_if_none(v.users.filter("default_region = 'PH'")))


@query
def u9_upsert_fx_history(v: Views) -> DataFrame:
    day_id = F.expr("datediff(as_of, date'2000-01-01') * 10L + length(quote_currency) + ascii(quote_currency) % 7")
    history = v.fx_history.filter("day(as_of) < 20").withColumn("id", day_id)
    first = v.fx_history.filter("day(as_of) % 2 = 1").withColumn("seq", F.lit(1))
    second = v.fx_history.filter("day(as_of) > 15").withColumn("seq", F.lit(2))
    fetched = first.unionByName(second).withColumn(
        "rate", (F.col("rate") + F.col("seq")).cast("decimal(18,8)")
    ).withColumn("id", day_id + 1_000_000 * F.col("seq"))
    return fx.upsert_fx_history(history, fetched)


@query
def u10_upsert_fx_current(v: Views) -> DataFrame:
    current = v.fx_history.filter("day(as_of) = 10 and quote_currency <> 'EUR'")
    early = v.fx_history.filter("day(as_of) <= 8").withColumn("seq", F.lit(1))
    late = v.fx_history.filter("day(as_of) <= 20 and quote_currency <> 'PHP'").withColumn(
        "seq", F.lit(2)
    )
    number = F.ascii("quote_currency").cast("bigint")
    fetched = early.unionByName(late).withColumn("id", number + 1000 * F.col("seq"))
    return fx.upsert_fx_current(current.withColumn("id", number), fetched)


@query
def u11_fx_coverage(v: Views) -> DataFrame:
    days = v.timed.select("occurred_on").distinct()
    base = F.when(F.day("occurred_on") % 9 == 0, "EUR").otherwise("USD")
    requests = days.select(
        base.alias("base_currency"),
        F.date_add("occurred_on", -6).alias("start_on"),
        F.date_add("occurred_on", 5).alias("end_on"),
    )
    return fx.fx_coverage(v.fx_history, requests).select(
        "base_currency", "start_on", "end_on", "covered"
    )


def _rate_answers(v: Views) -> rates.RateAnswers:
    """Weekly requests; the history ends on the 19th, and every fourth day's request loads more."""
    day = F.col("occurred_on")
    asked = v.timed.select(
        F.datediff(day, F.lit(date(2000, 1, 1))).cast("bigint").alias("request_id"),
        F.when(F.day(day) % 9 == 0, "eur").otherwise("usd").alias("base_currency"),
        F.when(F.day(day) % 3 != 0, F.date_sub(day, 9)).alias("start_on"),
        day.alias("end_on"),
    ).distinct()
    loads = asked.filter("day(end_on) % 4 = 0 and base_currency = 'usd'")
    loaded = v.fx_history.join(loads.select("request_id", F.col("end_on").alias("as_of")), "as_of")
    loaded = loaded.withColumn("seq", F.col("request_id")).withColumn(
        "rate", (F.col("rate") + 1).cast("decimal(18,8)")
    )
    held = v.fx_history.filter("day(as_of) < 20")
    return rates.fx_rates_for_requests(asked, held, held.filter("day(as_of) = 10"), loaded)


@query
def fx_rates_for_requests(v: Views) -> DataFrame:
    return _rate_answers(v).requests.withColumn("quotes", F.array_join("quotes", ","))


@query
def fx_rate_points_for_requests(v: Views) -> DataFrame:
    return _rate_answers(v).points


@query
def u12_fx_series(v: Views) -> DataFrame:
    """The day-to-quotes maps unfolded again, for comparison."""
    series = fx.fx_series(v.fx_history, "usd", date(2024, 1, 5), date(2024, 1, 20))
    return series.select("as_of", F.explode("rates").alias("quote_currency", "rate"))
