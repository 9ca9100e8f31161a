"""Every registered query against its SQL twin, and the driver contract."""

import __spark_entry__ as contract
import compare
import pytest
from conftest import SMALL, spread, whole
from shopfloor.plans import catalog, catalog_sql

QUERIES, SQL = catalog.REGISTRY, catalog_sql.all_sql()
# Run with groups cut into many chunks too: one per kind of ordering or join.
SPREAD = [
    "spc_imr_limits",
    "spc_rules_nelson",
    "spc_xbar_s_points",
    "spc_u",
    "spc_normality",
    "spc_histogram",
    "risk_rank_ap",
    "risk_rank_per_step",
    "risk_pareto",
    "ingest_duplicates",
    "rel_links",
    "plan_build",
    "signals_violations",
    "signals_runs",
    "signals_pareto",
    "live_snapshot_xbar_r",
]


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SMALL)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    assert compare.difference(QUERIES[name](spark, SMALL).toPandas(), duck.execute(SQL[name]).df()) is None


@pytest.mark.parametrize("name", SPREAD)
def test_query_matches_sql_with_many_chunks(spark, duck, name):
    spread(spark, 40)
    try:
        found = QUERIES[name](spark, SMALL).toPandas()
    finally:
        whole(spark)
    assert compare.difference(found, duck.execute(SQL[name]).df()) is None


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() == 5
