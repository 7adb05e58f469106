"""Headline queries on one machine: prints one JSON line.

BENCH_SF_DIR picks the data, BENCH_CPUS the local threads. Every query is planned and run in
full; results go to Spark's no-op sink, so no rows pass through the driver.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from driver_queries.spark_queries import queries
from driver_queries.views import views
from purseflow.session import build_session

HEADLINES = (
    "w1_running_balance",
    "w2_running_balance_by_transaction",
    "w3_expense_deltas",
    "w5_active_salary",
    "w7_balance_with_fund",
    "w9_ledger_view",
    "j3_convert",
    "j6_fund_status",
    "j7_prior_period_delta",
    "a1_totals",
    "a2_per_category_totals",
    "a3_top_expense_categories",
    "a4_monthly_totals",
    "a5_monthly_expense_by_category",
    "a6_top5_plus_other",
    "a7_daily_totals",
    "a8_budget_status_month",
    "a8_budget_status_3m",
    "a8_budget_status_ytd",
    "a8_budget_status_all",
    "a13_overview",
    "a14_dashboard_summary",
    "p8_breakdown",
    "p11_payroll_register",
    "i1_insights",
    "u2_patch_transactions",
    "u3_delete_transactions",
    "u4_upsert_budgets",
    "u6_activate_profile",
    "s3_ingest_fx_payload",
    "s4_export_expenses",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.checkpoint.dir": os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = queries()
    loaded = views(spark, sf_dir)
    started = time.perf_counter()
    # Loading the pinned dimensions also warms the session up.
    loaded.matrix, loaded.categories
    run["x2_month_key"](spark, sf_dir).collect()
    seconds = {"load_dimensions": round(time.perf_counter() - started, 3)}
    for name in sys.argv[1:] or HEADLINES:
        started = time.perf_counter()
        run[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
