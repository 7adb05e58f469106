"""Batches of row changes merged into the tables.

A batch row has a sequence number ``seq`` (unique in the batch) and an ``op``. Results equal
applying the rows one by one in that order. Each function returns the new table, and where
rows can fail also the rejected rows with a ``reason``.

Checked batches are staged in the shared folder: several outputs use them, and the planner
knows their size. Tables are only left-, semi- or anti-joined to a batch, so a batch under the
broadcast threshold never shuffles the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from purseflow.operators.ledger import (
    with_budget_reason,
    with_direction_reason,
    write_currency,
)
from purseflow.operators.merging import last_of_batch, merged_by_key
from purseflow.operators.skew import previous_value
from purseflow.functions.payroll_rules import RULES, RuleSet
from purseflow.functions.periods import fund_period_start
from purseflow.operators.payroll import breakdown_json, payroll_rejects, profile_snapshot
from purseflow.schemas import MONTH_COLUMN, SCOPES
from purseflow.session import staged

PATCHABLE = ("category_id", "amount", "currency", "occurred_on", "occurred_time", "description")
USER_FIELDS = ("name", "email", "base_currency", "default_region")
BUDGET_KEY = ["user_id", "category_id", "year", "month"]
FUND_KEY = ["user_id", "scope", "period_start"]

# The user created when there is none.
DEFAULT_USER_NAME = "Breadwinner"
DEFAULT_CURRENCY = "USD"
DEFAULT_REGION = "US"


def _last_set(field: str) -> Column:
    """The value the last patch naming the field gave it, wrapped so that a set NULL shows."""
    named = F.array_contains("fields", field)
    return F.max_by(F.when(named, F.struct(field)), F.when(named, F.col("seq"))).alias(f"_{field}")


def _patched(field: str, change: Column | None = None) -> Column:
    value = F.col(f"_{field}.{field}") if change is None else change
    return F.when(F.col(f"_{field}").isNotNull(), value).otherwise(F.col(field)).alias(field)


def _matching(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a large table whose key occurs in a batch: a semi join, so that the batch can be
    broadcast and the table is not shuffled."""
    return table.join(wanted.select(*keys).distinct(), keys, "left_semi")


def _bases(users: DataFrame, changes: DataFrame) -> DataFrame:
    """Base currency of the users a batch mentions."""
    people = users.select(F.col("id").alias("user_id"), F.col("base_currency").alias("_base"))
    return _matching(people, changes, ["user_id"])


def _owned(rows: DataFrame, edits: DataFrame, *held: str) -> DataFrame:
    """Edits whose row exists by then and belongs to the same user, with columns of that row."""
    kept = [F.col(c).alias(f"_held_{c}") for c in held]
    owners = rows.select("id", F.col("user_id").alias("_owner"), "_born", *kept)
    known = owners.join(edits, "id")
    return known.filter(
        (F.col("_owner") == F.col("user_id")) & (F.col("seq") > F.col("_born"))
    ).drop("_owner", "_born")


def _done(owned: DataFrame) -> DataFrame:
    """Owned edits up to and including the first delete of their row."""
    deletes = (
        owned.filter(F.col("op") == "delete").groupBy("id").agg(F.min("seq").alias("_gone_at"))
    )
    within = F.col("_gone_at").isNull() | (F.col("seq") <= F.col("_gone_at"))
    return owned.join(deletes, "id", "left").filter(within).drop("_gone_at")


# ----------------------------------------------------------------------------- transactions


def transaction_inserts(
    base: DataFrame, changes: DataFrame, categories: DataFrame, users: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(accepted inserts with their currency resolved, rejected inserts).

    An id that the table holds, or that an earlier insert of the batch took, is rejected, and so
    is a row whose currency neither the row nor its region nor its user tells.
    """
    asked = changes.filter(F.col("op") == "insert")
    code = write_currency(F.col("currency"), F.col("region"), F.col("_base"))
    resolved = asked.join(_bases(users, asked), "user_id", "left").withColumn("currency", code)
    judged = with_direction_reason(resolved.drop("_base"), categories)
    unknown = F.when(F.col("currency").isNull(), "no currency")
    judged = judged.withColumn("reason", F.coalesce("reason", unknown))
    taken = _matching(base.select("id"), asked, ["id"]).distinct().withColumn("_taken", F.lit(True))
    good = F.when(F.col("reason").isNull(), F.col("seq"))
    first = F.min(good).over(Window.partitionBy("id"))
    used = F.when(F.col("_taken") | (F.col("seq") > F.col("_first")), "id already used")
    numbered = judged.withColumn("_first", first).join(taken, "id", "left")
    fit = numbered.withColumn("reason", F.coalesce("reason", used)).drop("_first", "_taken")
    checked = staged(fit, "inserts")
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )


@dataclass(frozen=True)
class TransactionEffects:
    """What a batch does: rows to add, edits of rows by id, and the rows refused with a reason."""

    inserts: DataFrame
    owned: DataFrame
    rejected: DataFrame

    def by_id(self) -> DataFrame:
        """Per edited row whether it goes, and each field's last value.

        A deleted row is gone whatever its patches.
        """
        return self.owned.groupBy("id").agg(
            F.bool_or(F.col("op") == "delete").alias("_deleted"),
            *[_last_set(field) for field in PATCHABLE],
        )

    def touched_days(self) -> DataFrame:
        """Days (day) that rows are added to, edited on, or moved to."""
        moved = F.array_contains("fields", "occurred_on") & (F.col("op") == "patch")
        return (
            self.inserts.select(F.col("occurred_on").alias("day"))
            .union(self.owned.select("_held_occurred_on"))
            .union(self.owned.filter(moved).select("occurred_on"))
        )

    def touched_ids(self) -> DataFrame:
        return self.inserts.select("id").union(self.owned.select("id")).distinct()


def transaction_effects(
    base: DataFrame, changes: DataFrame, categories: DataFrame, users: DataFrame
) -> TransactionEffects:
    """The effects of a batch; of ``base`` only the rows with ids of the batch matter."""
    inserts, bad_inserts = transaction_inserts(base, changes, categories, users)
    keys = ["id", "user_id", "occurred_on"]
    rows = base.select(*keys, F.lit(-1).cast("bigint").alias("_born")).unionByName(
        inserts.select(*keys, F.col("seq").cast("bigint").alias("_born"))
    )
    edits = changes.filter(F.col("op").isin("patch", "delete"))
    owned = staged(_owned(rows, edits, "occurred_on"), "edits")
    bad_edits = edits.join(_done(owned).select("seq"), "seq", "left_anti").select(
        "seq", "op", "id", "user_id", F.lit("transaction not found").alias("reason")
    )
    rejected = bad_inserts.select("seq", "op", "id", "user_id", "reason").unionByName(bad_edits)
    return TransactionEffects(inserts, owned, rejected)


def merge_effects(base: DataFrame, effects: TransactionEffects) -> DataFrame:
    """Rows after the effects: edited, without deleted ones, and with the inserts.

    Columns that the batch lacks are NULL in its inserts.
    """
    columns = base.columns
    given = [name for name in columns if name in effects.inserts.columns]
    rows = base.unionByName(effects.inserts.select(*given), allowMissingColumns=True)
    merged = rows.join(effects.by_id(), "id", "left").filter(
        ~F.coalesce("_deleted", F.lit(False))
    )
    upper = F.upper(F.col("_currency.currency"))
    return merged.select(
        *[
            _patched(name, upper if name == "currency" else None)
            if name in PATCHABLE
            else F.col(name)
            for name in columns
        ]
    )


def apply_transactions(
    base: DataFrame, changes: DataFrame, categories: DataFrame, users: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Insert, patch and delete transactions.

    Patches list the fields they set in ``fields`` and never change the direction. A patch or
    delete of an unknown, already deleted or other user's row is rejected.
    """
    base = base.drop(MONTH_COLUMN)
    effects = transaction_effects(base, changes, categories, users)
    return merge_effects(base, effects), effects.rejected


# ---------------------------------------------------------------------------------- budgets


def apply_budgets(
    base: DataFrame, changes: DataFrame, categories: DataFrame, users: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Upsert and delete budgets by (user, category, year, month)."""
    values = ["limit_amount", "currency"]
    code = F.upper(F.coalesce(F.nullif("currency", F.lit("")), F.col("_base")))
    resolved = changes.join(_bases(users, changes), "user_id", "left").withColumn("currency", code)
    checked = staged(with_budget_reason(resolved.drop("_base"), categories), "budget-changes")
    refused = (F.col("op") == "upsert") & F.col("reason").isNotNull()
    bad = checked.filter(refused).select("seq", "op", *BUDGET_KEY, "reason")
    valid = checked.filter(~refused).drop("reason")
    held = _matching(base.select(*BUDGET_KEY), valid, BUDGET_KEY).withColumn("_held", F.lit(True))
    # What stands before each row: the operation ahead of it in the batch, else the table.
    key = F.concat_ws("/", *BUDGET_KEY)
    ordered = previous_value(
        valid.withColumn("_key", key), "_key", [F.col("seq")], "op", "_before"
    ).drop("_key")
    placed = ordered.join(held, BUDGET_KEY, "left")
    stands = F.coalesce(F.col("_before") == "upsert", F.col("_held"), F.lit(False))
    missing = placed.filter((F.col("op") == "delete") & ~stands).select(
        "seq", "op", *BUDGET_KEY, F.lit("budget not found").alias("reason")
    )
    final = last_of_batch(base, valid, BUDGET_KEY, values)
    return merged_by_key(base, final), bad.unionByName(missing)


def apply_fund_overrides(base: DataFrame, changes: DataFrame, users: DataFrame) -> DataFrame:
    """Upsert and reset opening-fund overrides; resetting a missing one does nothing."""
    values = ["amount", "currency"]
    code = F.upper(F.coalesce(F.nullif("currency", F.lit("")), F.col("_base")))
    asked = changes.join(_bases(users, changes), "user_id", "left").withColumn("currency", code)
    final = staged(last_of_batch(base, asked, FUND_KEY, values), "fund-changes")
    return merged_by_key(base, final)


def apply_funds_by_anchor(
    base: DataFrame, changes: DataFrame, users: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Upsert and reset overrides given by (scope, anchor) instead of the period's first day."""
    known = _bases(users, changes).select("user_id", F.lit(True).alias("_known"))
    reason = F.when(~F.coalesce(F.col("scope").isin(list(SCOPES)), F.lit(False)), "unknown scope").when(
        F.col("_known").isNull(), "user not found"
    )
    judged = changes.join(known, "user_id", "left").withColumn("reason", reason).drop("_known")
    checked = staged(judged, "fund-requests")
    good = checked.filter(F.col("reason").isNull()).withColumn(
        "period_start", fund_period_start(F.col("scope"), F.col("anchor"))
    )
    rejected = checked.filter(F.col("reason").isNotNull())
    return apply_fund_overrides(base, good.drop("anchor", "reason"), users), rejected


def delete_budgets(base: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete budgets by (seq, id, user_id); an unknown, deleted or other user's id is rejected."""
    rows = base.withColumn("_born", F.lit(-1).cast("bigint"))
    asked = changes.withColumn("op", F.lit("delete"))
    done = _done(staged(_owned(rows, asked), "budget-deletes"))
    kept = base.join(done.select("id"), "id", "left_anti").select(*base.columns)
    rejected = changes.join(done.select("seq"), "seq", "left_anti").withColumn(
        "reason", F.lit("budget not found")
    )
    return kept, rejected


# ---------------------------------------------------------------------------------- profiles


def create_profiles(
    base: DataFrame, asked: DataFrame, actions: DataFrame | None = None, rules: RuleSet = RULES
) -> tuple[DataFrame, DataFrame]:
    """Store profiles from calculator input, with the breakdown computed when they are made.

    ``asked`` holds seq, id, user_id, region, gross_amount, pay_period, tax_year (NULL: the usual
    one), make_active and the time ``at``, and may hold other columns of the table. Input that no
    rule applies to is rejected; ``actions`` of the same batch are those of ``apply_profiles``.
    """
    bad = payroll_rejects(asked, rules).select("seq", "id", "user_id", "reason")
    good = asked.join(bad.select("seq"), "seq", "left_anti")
    made = profile_snapshot(good, rules).withColumns(
        {"is_active": F.col("make_active"), "created_at": F.col("at"), "updated_at": F.col("at")}
    )
    kinds = dict(base.dtypes)
    if kinds.get("breakdown") == "string":
        made = made.withColumn("breakdown", breakdown_json(F.col("breakdown")))
    fields = [
        (F.col(n) if n in made.columns else F.lit(None)).cast(kinds[n]).alias(n) for n in base.columns
    ]
    if actions is None:
        actions = good.limit(0).select("seq", F.lit("activate").alias("op"), "id", "user_id", "at")
    table, refused = apply_profiles(base, staged(made.select("seq", *fields), "profiles"), actions)
    return table, bad.unionByName(refused.select("seq", "id", "user_id", "reason"))



def apply_profiles(
    base: DataFrame, created: DataFrame, actions: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Create, activate and delete salary profiles; a user's new active profile clears the rest.

    ``created`` holds new profile rows with ``seq`` and the wished ``is_active``; ``actions``
    hold seq, op (activate or delete), id, user_id and the time ``at``. ``updated_at`` moves
    when the active flag of a row flips.
    """
    columns = base.columns
    rows = base.withColumn("_born", F.lit(-1).cast("bigint")).unionByName(
        created.select(*columns, F.col("seq").cast("bigint").alias("_born"))
    )
    owned = staged(_owned(rows, actions), "profile-actions")
    done = _done(owned)
    # Every activation, be it an action or a profile created active, ordered per user.
    activated = done.filter(F.col("op") == "activate")
    turns = staged(
        activated.select("user_id", "id", F.col("seq").cast("bigint"), "at").unionByName(
            created.filter("is_active").select(
                "user_id", "id", F.col("seq").cast("bigint"), F.col("updated_at").alias("at")
            )
        ),
        "profile-turns",
    )
    by_user = turns.groupBy("user_id").agg(
        F.max_by("id", "seq").alias("_active_id"),
        F.min("seq").alias("_first"),
        F.min_by("at", "seq").alias("_first_at"),
    )
    # A turn switches the profile before it off; a repeated activation switches nothing.
    ordered = previous_value(turns, "user_id", [F.col("seq")], "id", "_before")
    flips = ordered.filter(F.col("_before").isNull() | (F.col("_before") != F.col("id")))
    on = flips.groupBy("id").agg(F.max("seq").alias("_on"), F.max_by("at", "seq").alias("_on_at"))
    off = (
        flips.filter(F.col("_before").isNotNull())
        .groupBy(F.col("_before").alias("id"))
        .agg(F.max_by("at", "seq").alias("_off_at"))
    )
    untouched = F.col("_active_id").isNull()
    active = F.col("_active_id") == F.col("id")
    # An already active profile that comes first in the batch was never switched.
    stayed_on = F.col("is_active") & (F.col("_on") == F.col("_first"))
    changed_at = (
        F.when(untouched | (active & stayed_on), F.col("updated_at"))
        .when(active, F.col("_on_at"))
        .when(F.col("_on").isNotNull(), F.col("_off_at"))
        .when(F.col("is_active"), F.col("_first_at"))
        .otherwise(F.col("updated_at"))
    )
    flag = F.when(untouched, F.col("is_active")).otherwise(active)
    merged = (
        rows.join(owned.filter(F.col("op") == "delete").select("id"), "id", "left_anti")
        .join(by_user, "user_id", "left")
        .join(on, "id", "left")
        .join(off, "id", "left")
    )
    values = {"is_active": flag, "updated_at": changed_at}
    result = merged.select(*[values.get(name, F.col(name)).alias(name) for name in columns])
    rejected = actions.join(done.select("seq"), "seq", "left_anti").withColumn(
        "reason", F.lit("profile not found")
    )
    return result, rejected


# --------------------------------------------------------------------- categories and users


def add_categories(
    base: DataFrame, changes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Add user-made categories (seq, id, name, direction, user_id); names are unique per
    direction, and the first of equal new ones wins."""
    key = ["name", "direction"]
    first = changes.groupBy(*key).agg(F.min("seq").alias("seq"))
    taken = _matching(base.select(*key), changes, key)
    fresh = changes.join(first, [*key, "seq"], "left_semi").join(taken, key, "left_anti")
    added = {
        "statutory": F.lit(False),
        "is_system": F.lit(False),
        "region": F.lit(None).cast("string"),
    }
    new_rows = fresh.select(*[added.get(name, F.col(name)).alias(name) for name in base.columns])
    rejected = changes.join(fresh.select("seq"), "seq", "left_anti").withColumn(
        "reason", F.lit("category exists")
    )
    return base.unionByName(new_rows), rejected


def update_users(base: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patch name, email, base currency and region of users; unknown users are rejected."""
    fold = changes.groupBy("id").agg(*[_last_set(field) for field in USER_FIELDS])
    merged = base.join(fold, "id", "left")
    result = merged.select(
        *[_patched(name) if name in USER_FIELDS else F.col(name) for name in base.columns]
    )
    known = _matching(base.select("id"), changes, ["id"])
    rejected = changes.join(known, "id", "left_anti").withColumn(
        "reason", F.lit("user not found")
    )
    return result, rejected


def default_user_if_none(users: DataFrame) -> DataFrame:
    """The table itself, or one default user when it is empty."""
    spark = users.sparkSession
    value = {
        "id": F.lit(1),
        "name": F.lit(DEFAULT_USER_NAME),
        "base_currency": F.lit(DEFAULT_CURRENCY),
        "default_region": F.lit(DEFAULT_REGION),
    }
    kinds = dict(users.dtypes)
    row = spark.range(1).select(
        *[value.get(n, F.lit(None)).cast(kinds[n]).alias(n) for n in users.columns]
    )
    # The subquery stops at the first row, whatever the size of the table.
    return users.unionByName(row.filter(~users.limit(1).exists()))
