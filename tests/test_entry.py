"""Driver contract, and every registered query against its DuckDB oracle
on the smallest tables (the same check the driver runs at sf0.01)."""

import pytest

import __spark_entry__ as E
from tests.oracle_check import digest, duck

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "doc_url" in df.columns


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, name):
    got = digest(E.queries()[name](spark, SF).toArrow())
    exp = digest(duck(SF).sql(E.oracle_sql()[name]).to_arrow_table())
    assert got[0] == exp[0] and got[1] == exp[1], (got[:2], exp[:2])
    assert got[2] == exp[2] and got[3] == exp[3]
