"""Every registered query with an oracle, against DuckDB at sf0.001 (the
driver repeats this at sf0.01)."""

import pytest

import __spark_entry__ as entry
from tabulon.plans.compare import compare

from conftest import SF001

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert set(df.columns) == {"doc_id", "term", "weight"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck001, name):
    diff = compare(QUERIES[name](spark, SF001), duck001, ORACLES[name])
    assert diff is None, diff
