"""Ledger-shaped views over the given parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from purseflow.operators.fx import rate_matrix
from purseflow.operators.skew import pinned
from purseflow.sources.seeds import reference_rates

SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}

CURRENCY = "case n_regionkey when 0 then 'PHP' when 2 then 'AUD' when 3 then 'EUR' else 'USD' end"
REGION = "case n_regionkey when 0 then 'PH' when 1 then 'US' when 2 then 'AU' when 3 then 'EU' end"


class Views:
    """The views of one session and folder. Small dimensions are pinned once per session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.root = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{name}.parquet")

    @cached_property
    def matrix(self) -> DataFrame:
        return pinned(rate_matrix(reference_rates(self.spark)))

    @cached_property
    def categories(self) -> DataFrame:
        sides = (
            self.transactions.select("category_id", "direction")
            .union(self.timed.select("category_id", "direction"))
            .filter(~F.col("category_id").isin(14, 102))
            .distinct()
        )
        return pinned(
            sides.selectExpr(
                "category_id id",
                "concat('CAT_', cast(category_id as string)) name",
                "direction",
                "category_id in (9, 12) statutory",
            )
        )

    @cached_property
    def _people(self) -> DataFrame:
        customer, nation = self.table("customer"), self.table("nation")
        return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))

    @cached_property
    def users(self) -> DataFrame:
        return self._people.selectExpr(
            "c_custkey id",
            "c_name name",
            f"{CURRENCY} base_currency",
            f"coalesce({REGION}, 'US') default_region",
        )

    @cached_property
    def _orders(self) -> DataFrame:
        homes = self._people.selectExpr(
            "c_custkey o_custkey", "n_regionkey", f"{CURRENCY} currency", f"{REGION} region"
        )
        return self.table("orders").join(homes, "o_custkey")

    @cached_property
    def transactions(self) -> DataFrame:
        kind = "cast(substr(o_orderpriority, 1, 1) as int)"
        return self._orders.selectExpr(
            "o_orderkey id",
            "o_custkey user_id",
            f"case when {kind} in (1, 2) then 'inbound' else 'outbound' end direction",
            f"({kind} - 1) * 3 + case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end "
            "category_id",
            "cast(o_totalprice as decimal(14,2)) amount",
            "currency",
            "region",
            "cast(o_orderdate as date) occurred_on",
            "cast(null as string) occurred_time",
        )

    @cached_property
    def timed(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id id",
            "user_id",
            "case when event_type in ('signup', 'view') then 'inbound' else 'outbound' end direction",
            "case event_type when 'click' then 100 when 'error' then 101 when 'purchase' then 102 "
            "when 'signup' then 103 else 104 end category_id",
            "cast(value as decimal(14,2)) amount",
            "case user_id % 4 when 0 then 'USD' when 1 then 'PHP' when 2 then 'AUD' else 'EUR' end "
            "currency",
            "case user_id % 5 when 0 then 'US' when 1 then 'PH' when 2 then 'AU' when 3 then 'EU' "
            "end region",
            "cast(ts as date) occurred_on",
            "case when event_id % 7 <> 0 then date_format(ts, 'HH:mm:ss') end occurred_time",
        )

    @cached_property
    def budgets(self) -> DataFrame:
        factor = "case month % 3 when 0 then 0.8 when 1 then 1.2 else 2.0 end"
        return (
            self.transactions.filter("direction = 'outbound' and (user_id + category_id) % 3 <> 0")
            .groupBy(
                "user_id",
                "category_id",
                F.year("occurred_on").alias("year"),
                F.month("occurred_on").alias("month"),
            )
            .agg(F.max("amount").alias("most"), F.min("currency").alias("least"))
            .selectExpr(
                "user_id",
                "category_id",
                "year",
                "month",
                f"cast(round(most * {factor}, 2) as decimal(14,2)) limit_amount",
                "case when month % 2 = 0 then 'USD' else least end currency",
            )
        )

    @cached_property
    def fund_overrides(self) -> DataFrame:
        slot = "c_custkey % 40"
        return self._people.filter("c_custkey % 10 = 0").selectExpr(
            "c_custkey user_id",
            f"case {slot} when 0 then 'month' when 10 then '3m' when 20 then 'ytd' else 'all' end "
            "scope",
            f"cast(case {slot} when 0 then '1998-06-01' when 10 then '1998-04-01' "
            "when 20 then '1998-01-01' else '1970-01-01' end as date) period_start",
            "cast(c_acctbal as decimal(14,2)) amount",
            f"{CURRENCY} currency",
        )

    @cached_property
    def profiles(self) -> DataFrame:
        return self._orders.filter("n_regionkey <> 4").selectExpr(
            "o_orderkey id",
            "o_custkey user_id",
            "region",
            "currency",
            "cast(round(cast(o_totalprice as decimal(14,2)) * case n_regionkey when 0 then 20.0 "
            "when 1 then 2.0 else 1.0 end * case when o_orderkey % 2 = 0 then 0.1 else 1.0 end, 2) "
            "as decimal(14,2)) gross_amount",
            "case when o_orderkey % 2 = 0 then 'monthly' else 'annual' end pay_period",
            "year(o_orderdate) tax_year",
            "o_orderstatus = 'O' is_active",
            "o_orderdate updated_at",
        )

    @cached_property
    def fx_history(self) -> DataFrame:
        quote = "case event_type when 'click' then 'PHP' when 'view' then 'AUD' else 'EUR' end"
        return (
            self.table("events")
            .filter("event_type in ('click', 'view', 'purchase')")
            .groupBy(F.expr(quote).alias("quote_currency"), F.to_date("ts").alias("as_of"))
            .agg(F.max_by("value", "ts").cast("decimal(18,8)").alias("rate"))
            .select(
                F.expr("substr(concat('USD', quote_currency), 1, 3)").alias("base_currency"),
                "quote_currency",
                "rate",
                "as_of",
            )
        )


_open: dict[tuple[str, str], Views] = {}


def views(spark: SparkSession, sf_dir: str) -> Views:
    """The views of a folder, shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Views(spark, sf_dir)
    return _open[key]
