"""Every registered query against its SQL counterpart, on the smallest tables."""

import pytest

import __spark_entry__ as contract_entry
from contract.check import compare, open_views
from contract.oracle import ORACLE
from contract.queries import REGISTRY


@pytest.fixture(scope="module")
def views(sf_dir):
    return open_views(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(name, spark, views, sf_dir):
    assert compare(name, spark, views, sf_dir) is None


@pytest.mark.parametrize("name", ["baseline_summary", "topology_features", "run_metadata"])
def test_runs_without_sql(name, spark, sf_dir):
    assert name in REGISTRY and name not in ORACLE
    assert REGISTRY[name](spark, sf_dir).count() > 0


def test_entry(spark):
    rows = contract_entry.entry(spark).collect()
    assert len(rows) == 5 and sum(r["total_samples"] for r in rows) == 1000
    assert set(contract_entry.oracle_sql()) <= set(contract_entry.queries())
