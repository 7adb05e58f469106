"""Payroll over a table of salary profiles: narrow column expressions, no shuffle."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from purseflow.functions.money import money
from purseflow.functions.payroll_rules import (
    DEFAULT_TAX_YEAR,
    INFO,
    RULES,
    SOCIAL,
    TAX,
    PayrollRule,
    RuleSet,
    bracket_tax,
    choose,
    exact,
)
from purseflow.schemas import TOTAL
from purseflow.session import small_table

# Scale 14 holds every product of the rules exactly.
_EXACT = "decimal(30,14)"


def annualize(gross: Column, pay_period: Column) -> Column:
    return money(gross * F.when(pay_period == "monthly", 12).otherwise(1))


def per_period(annual: Column, pay_period: Column) -> Column:
    return F.when(pay_period == "monthly", money(annual / F.lit(Decimal(12)))).otherwise(annual)


def _pick(rules: RuleSet, value: Callable[[PayrollRule], str | None], kind: str) -> Column:
    """A constant of the row's rule."""
    return choose([value(rule) for rule in rules.values()], F.col("_rule"), kind)


def _amount_kind(column: Column) -> Column:
    return column.cast("decimal(24,6)")


def _contribution(rules: RuleSet, i: int) -> Column:
    """Exact amount of the i-th contribution of the row's rule; NULL if it has fewer."""
    gross = F.col("_gross")
    entries = [r.contributions[i] if i < len(r.contributions) else None for r in rules.values()]

    def constant(field: str, kind: str = "decimal(14,2)") -> Column:
        return choose([e and getattr(e, field) for e in entries], F.col("_rule"), kind)

    def used(field: str) -> bool:
        return any(e and getattr(e, field) for e in entries)

    base = gross
    # Least and greatest skip NULLs: a rule without a bound leaves the income as it is.
    if used("floor"):
        base = F.greatest(base, constant("floor"))
    if used("ceiling"):
        base = F.least(base, constant("ceiling"))
    amount = base * constant("rate", "decimal(5,4)")
    if used("extra_rate"):
        above = F.greatest(gross - constant("extra_above"), exact(0))
        extra = above * constant("extra_rate", "decimal(5,4)")
        amount = amount + F.coalesce(extra, exact(0))
    if used("only_above"):
        amount = F.when(gross <= constant("only_above"), exact(0)).otherwise(amount)
    return _amount_kind(amount)


def _social(rules: RuleSet, width: int) -> Column:
    """Sum of the deducted contributions; informative ones are left out."""
    total = exact(0)
    for i in range(width):
        informs = [
            region
            for region, rule in rules.items()
            if i < len(rule.contributions) and rule.contributions[i].kind == INFO
        ]
        slot = F.coalesce(F.col(f"_line{i}"), exact(0))
        if informs:
            slot = F.when(F.col("region").isin(informs), exact(0)).otherwise(slot)
        total = total + slot
    return _amount_kind(total)


def _taxable(rules: RuleSet) -> Column:
    off = _pick(rules, lambda rule: rule.deduction, "decimal(14,2)")
    deducting = [region for region, rule in rules.items() if rule.social_is_deductible]
    social = F.when(F.col("region").isin(deducting), F.col("_social")).otherwise(exact(0))
    return _amount_kind(F.greatest(F.col("_gross") - off - social, exact(0)))


def _tax(rules: RuleSet) -> Column:
    tax = bracket_tax(
        F.col("_taxable"), [rule.brackets for rule in rules.values()], F.col("_rule")
    ).cast(_EXACT)
    for region, rule in rules.items():
        if rule.tariff is not None:
            own = rule.tariff(F.col("_taxable")).cast(_EXACT)
            tax = F.when(F.col("region") == region, own).otherwise(tax)
    return tax


def _item(key: str, label: str, amount: Column, kind: str) -> Column:
    return F.struct(
        F.lit(key).alias("key"),
        F.lit(label).alias("label"),
        amount.alias("amount"),
        F.lit(kind).alias("kind"),
    )


def _items(rule: PayrollRule) -> Column:
    """Gross, deductions, net, then what is only informative."""
    deducted, informative = [], []
    for i, entry in enumerate(rule.contributions):
        item = _item(entry.key, entry.label, money(F.col(f"_line{i}")), entry.kind)
        (informative if entry.kind == INFO else deducted).append(item)
    tax = _item(rule.tax_key, rule.tax_label, F.col("_total_tax"), TAX)
    deducted = [tax, *deducted] if rule.tax_comes_first else [*deducted, tax]
    return F.array(
        _item("gross", rule.gross_label, F.col("_gross").cast(TOTAL), "gross"),
        *deducted,
        _item("net", rule.net_label, F.col("_net"), "net"),
        *informative,
    )


def with_breakdown(profiles: DataFrame, rules: RuleSet = RULES) -> DataFrame:
    """Profiles of a known region with their ``breakdown`` struct.

    The steps are projections of their own, each used several times by the next, so that every
    amount is computed once per row.
    """
    width = max(len(rule.contributions) for rule in rules.values())
    annual = annualize(F.col("gross_amount"), F.col("pay_period")).cast("decimal(16,2)")
    number = F.array_position(F.array(*[F.lit(region) for region in rules]), F.col("region"))
    known = profiles.filter(F.col("region").isin(list(rules))).withColumns(
        {"_gross": annual, "_rule": number.cast("int")}
    )
    slots = {f"_line{i}": _contribution(rules, i) for i in range(width)}
    contributed = known.withColumns(slots).withColumn("_social", _social(rules, width))
    taxed = contributed.withColumn("_taxable", _taxable(rules)).withColumn("_tax", _tax(rules))
    gross, tax, social = F.col("_gross").cast(TOTAL), F.col("_tax"), F.col("_social")
    settled = taxed.withColumns(
        {
            "_total_tax": money(tax),
            "_net": money(gross - (tax + social)),
            "_deducted": money(tax + social),
        }
    )
    period, net, deducted = F.col("pay_period"), F.col("_net"), F.col("_deducted")
    rate = F.when(gross != 0, F.bround(deducted / gross, 4)).otherwise(F.lit(0))
    currencies = F.array(*[F.lit(rule.currency) for rule in rules.values()])
    items = reduce(
        lambda rest, rule: F.when(F.col("region") == rule.region, _items(rule)).otherwise(rest),
        rules.values(),
        F.lit(None),
    )
    breakdown = F.struct(
        F.col("region").alias("region"),
        F.element_at(currencies, F.col("_rule")).alias("currency"),
        F.coalesce("tax_year", F.lit(DEFAULT_TAX_YEAR)).alias("tax_year"),
        period.alias("pay_period"),
        gross.alias("gross_annual"),
        net.alias("net_annual"),
        per_period(gross, period).alias("gross_period"),
        per_period(net, period).alias("net_period"),
        F.col("_total_tax").alias("total_tax"),
        money(social).alias("total_social"),
        deducted.alias("total_deductions"),
        rate.cast("decimal(20,4)").alias("effective_rate"),
        items.alias("items"),
    )
    helpers = [name for name in settled.columns if name.startswith("_")]
    return settled.withColumn("breakdown", breakdown).drop(*helpers)


def payroll_rejects(profiles: DataFrame, rules: RuleSet = RULES) -> DataFrame:
    """Profiles no rule applies to, with the reason."""
    unknown = F.col("region").isNull() | ~F.col("region").isin(list(rules))
    reason = F.when(unknown, "no rule for the region").when(
        F.col("gross_amount") <= 0, "gross must be positive"
    )
    return profiles.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def payroll_run(
    profiles: DataFrame, rules: RuleSet = RULES
) -> tuple[DataFrame, DataFrame]:
    """(profiles with breakdown, rejected profiles)."""
    positive = profiles.filter(F.col("gross_amount") > 0)
    return with_breakdown(positive, rules), payroll_rejects(profiles, rules)


def payroll_items(paid: DataFrame, view: str = "annual") -> DataFrame:
    """One row per line item as shown on a payslip.

    The period view divides by 12, deductions are negative, and the net line is left out.
    """
    if view not in ("annual", "period"):
        raise ValueError("view must be annual or period")
    # Items are never empty; the outer form keeps the planner from filtering on their size,
    # which would copy the whole rule expression below the explode.
    rows = paid.select(
        F.col("id").alias("profile_id"), "user_id", F.explode_outer("breakdown.items").alias("item")
    ).filter(F.col("item.kind") != "net")
    amount = F.col("item.amount")
    if view == "period":
        amount = money(amount / F.lit(Decimal(12)))
    shown = F.when(F.col("item.kind").isin(TAX, SOCIAL), -amount).otherwise(amount)
    return rows.select(
        "profile_id",
        "user_id",
        F.col("item.key").alias("key"),
        F.col("item.label").alias("label"),
        F.col("item.kind").alias("kind"),
        shown.cast(TOTAL).alias("amount"),
    )


def payroll_register(paid: DataFrame) -> DataFrame:
    """Totals of every line item by region."""
    return (
        paid.select("region", F.explode_outer("breakdown.items").alias("item"))
        .groupBy("region", F.col("item.kind").alias("kind"), F.col("item.key").alias("key"))
        .agg(F.sum("item.amount").cast("decimal(24,2)").alias("total"), F.count(F.lit(1)).alias("n"))
    )


def region_info(spark: SparkSession, rules: RuleSet = RULES) -> DataFrame:
    """The regions a rule set supports."""
    rows = [(rules[r].region, rules[r].currency, rules[r].modelled_as, True) for r in sorted(rules)]
    columns = "region string, currency string, modelled_as string, supported boolean"
    return small_table(spark, rows, columns)


def profile_snapshot(profiles: DataFrame, rules: RuleSet = RULES) -> DataFrame:
    """Rows to store: the input with its computed net, deductions and breakdown.

    A stored snapshot keeps its figures when a rule changes later.
    """
    paid = with_breakdown(profiles.filter(F.col("gross_amount") > 0), rules)
    currency = F.col("breakdown.currency")
    return (
        paid.withColumn("currency", currency)
        .withColumn("tax_year", F.col("breakdown.tax_year"))
        .withColumn("net_amount", F.col("breakdown.net_annual"))
        .withColumn("total_deductions", F.col("breakdown.total_deductions"))
    )


def breakdown_json(breakdown: Column) -> Column:
    """The stored text form: amounts as text with two decimals."""
    amounts = (
        "gross_annual",
        "net_annual",
        "gross_period",
        "net_period",
        "total_tax",
        "total_social",
        "total_deductions",
        "effective_rate",
    )
    head = [breakdown[name].alias(name) for name in ("region", "currency", "tax_year", "pay_period")]
    body = [breakdown[name].cast("string").alias(name) for name in amounts]
    items = F.transform(
        breakdown["items"],
        lambda item: F.struct(
            item["key"].alias("key"),
            item["label"].alias("label"),
            item["amount"].cast("string").alias("amount"),
            item["kind"].alias("kind"),
        ),
    )
    return F.to_json(F.struct(*head, *body, items.alias("items")))


def active_salary(profiles: DataFrame) -> DataFrame:
    """The most recently updated active profile of each user; of equal times the highest id.

    Times and ids alone are aggregated; profiles come in by a semi join, so their other columns
    are not, and the input is read twice.
    """
    active = profiles.filter("is_active")
    newest = active.groupBy("user_id").agg(F.max(F.struct("updated_at", "id")).alias("_newest"))
    return active.join(newest.select("user_id", "_newest.id"), ["user_id", "id"], "left_semi").select(
        *profiles.columns
    )


def stored_salary_figures(profiles: DataFrame) -> DataFrame:
    """Net per period and deduction rate out of stored breakdowns, 0 where a figure is absent.

    The breakdown may be a struct, or JSON text as databases store it.
    """
    if dict(profiles.dtypes)["breakdown"] == "string":
        net = F.get_json_object("breakdown", "$.net_period")
        rate = F.get_json_object("breakdown", "$.effective_rate")
    else:
        net, rate = F.col("breakdown.net_period"), F.col("breakdown.effective_rate")
    return profiles.select(
        "user_id",
        F.col("currency").alias("salary_currency"),
        F.coalesce(net.cast(TOTAL), F.lit(0).cast(TOTAL)).alias("net_period"),
        F.coalesce(rate.cast("decimal(20,4)"), F.lit(0).cast("decimal(20,4)")).alias(
            "deduction_rate"
        ),
    )

