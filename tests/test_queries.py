"""Every registered query of the ledger against its DuckDB oracle, on the smallest tables."""

import pytest
from compare import compare, duck

from meterline.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


#: On so few rows these may rightly be empty.
MAY_BE_EMPTY = {"e19_threshold_alerts", "e16_source_share"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, con, sf_dir, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, sf_dir).count() > 0
        return
    said = compare(spark, con, sf_dir, name, QUERIES[name], ORACLES[name])
    assert said is None or said == "no rows" and name in MAY_BE_EMPTY, said


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 30
