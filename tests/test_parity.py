"""Every registered query against its SQL on the small tables."""

import pytest

import __spark_entry__ as entry_module
import parity

QUERIES = entry_module.queries()
ORACLES = entry_module.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return parity.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    difference, _, _ = parity.compare(spark, con, sf_dir, QUERIES[name], ORACLES[name])
    assert difference is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).columns[:3] == ["file_path", "repo", "ref"]
