"""Every registered query against its SQL text in DuckDB, and rules its plan must keep."""

import re
from pathlib import Path

import duckdb
import pytest

from driver_queries.oracles import oracle_sql
from driver_queries.spark_queries import queries

SF_DIR = Path("/root/testdata/sf0.001")
TABLES = ("nation", "customer", "orders", "events")
# Type names of the two engines.
SAME = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
    "timestamp_ntz": "TIMESTAMP",
}
# Exchanges into one partition only for one-row results: counts and the highest category id.
# or for the handful of reference rows that a seed numbers.
ONE_ROW_QUERIES = {
    "s1_read_jurisdictions",
    "s2_seed_jurisdictions",
    "s2_seed_rates",
    "s2_seed_reference",
    "s6_table_counts",
    "u8_default_user",
}

# How often a plan may read the stored orders, which transactions, budgets and profiles derive from.
READS = {
    "a1_totals": 1,
    "a8_budget_status_month": 1,
    "a8_budget_status_scopes": 1,
    "a13_overview": 3,
    "a14_dashboard_summary": 3,
    "i1_insights": 3,
    "j6_fund_status": 2,
    "w2_transaction_balance_kept": 0,
    "w5_active_salary": 2,
    "w6_carry_over_fund": 1,
}

pytestmark = pytest.mark.skipif(not SF_DIR.is_dir(), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def own_plan(df) -> str:
    """The physical plan without the plans of pinned dimensions and of one-row subqueries."""
    lines, inside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :|+-*"))
        if inside is not None and depth > inside:
            continue
        inside = depth if "InMemoryTableScan" in line or " Subquery " in line else None
        lines.append(line)
    return "\n".join(lines)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, str(SF_DIR))
    plan = own_plan(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"PythonUDF|ArrowEvalPython|MapInPandas", plan)
    if name not in ONE_ROW_QUERIES:
        assert "SinglePartition" not in plan
    if name in READS:
        assert len(re.findall(r"FileScan parquet .*orders\.parquet", plan)) == READS[name]

    expected = duck.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(expected.columns)
    kinds = {c: SAME.get(t, t.upper()) for c, t in df.dtypes}
    assert kinds == {c: str(t) for c, t in zip(expected.columns, expected.types)}

    order = sorted(df.columns)

    def normal(rows, columns):
        at = [columns.index(c) for c in order]
        return sorted(tuple(str(row[i]) for i in at) for row in rows)

    found = normal(df.collect(), df.columns)
    assert found == normal(expected.fetchall(), expected.columns)
    assert found
