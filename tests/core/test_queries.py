"""Every registered query with SQL against DuckDB, and what all plans must keep to."""

import os

import pytest

from fieldcanon.operators.standardize import standardize, standardize_analytics
from fieldcanon.plans import derived, oracle, queries
from fieldcanon.countries import country_table
from fieldcanon.registry import CATCH_ALL, FIELDS

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    tidy = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(tidy(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_duckdb(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    want = duck.sql(oracle.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), want.columns)


def test_labels_are_in_the_closed_lists(spark):
    allowed = {x for _, labels, _ in FIELDS.values() for x in labels} | {"Unknown field type"}
    raw = derived.raw_values(spark, DATA)
    out = standardize_analytics(raw, country_table(spark))
    assert out.count() == raw.count()
    assert {r[0] for r in out.select("Standardized Value").distinct().collect()} <= allowed


def test_one_plan_is_the_same_as_one_for_each_field(spark):
    raw = derived.raw_values(spark, DATA).where("fieldType = 'Business Legal Form'").repartition(7)
    whole = {r.row_id: r["Standardized Value"] for r in standardize_analytics(raw, country_table(spark)).collect()}
    alone = {r.row_id: r["Standardized Value"] for r in standardize(raw, "inputText", "business_legal_form").collect()}
    assert whole == alone and CATCH_ALL in whole.values()


@pytest.mark.parametrize("name", ["standardize_mixed", "standardize_with_lookup", "build_lookup", "conflict_audit", "batch_plan", "rules_brn", "correction_diff", "run_stats"])
def test_plans(spark, name):
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "PythonUDF" not in plan and "Python" not in plan
    physical = plan.split("== Physical Plan ==")[1]
    assert "ReadSchema" in physical and "SinglePartition" not in physical  # no window or aggregate over the whole table in one task
