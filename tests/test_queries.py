"""Every query of the core against its SQL; those without SQL run and keep their schema."""

from importlib import import_module

import pytest

from cardloom.plans import MODULES
from tests.conftest import same

PLANS = [import_module(f"cardloom.plans.{m}") for m in MODULES]
QUERIES = {n: f for p in PLANS for n, f in p.QUERIES.items()}
SQL = {n: s for p in PLANS for n, s in p.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, data, name):
    same(QUERIES[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and all(0 <= r.intensity <= 5 for r in rows)
    assert set(entry.oracle_sql()) <= set(entry.queries())
