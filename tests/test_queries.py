"""Every query against its SQL on the smallest tables, as the driver does at a larger scale."""

import pytest

from ledgerloom.plans import catalogue, catalogue_evidence, catalogue_sql, training, training_sql
from tests.conftest import rows, same_as_sql

TRAINING = {n: f for n, f in vars(training).items() if n.startswith("p") and n[1:2].isdigit()}
CASES = {**catalogue.QUERIES, **catalogue_evidence.QUERIES, **TRAINING}
SQL = {**catalogue_sql.ORACLES, **catalogue_evidence.ORACLES, **training_sql.ORACLES}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf_dir, duck, name):
    same_as_sql(CASES[name](spark, sf_dir), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(CASES.keys() - SQL.keys()))
def test_runs_twice_alike(spark, sf_dir, name):
    assert rows(CASES[name](spark, sf_dir)) == rows(CASES[name](spark, sf_dir))


def test_entry(spark, sf_dir, monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setenv("ENTRY_SF_DIR", sf_dir)
    assert e.entry(spark).count() > 0
    assert e.oracle_sql().keys() <= e.queries().keys()
