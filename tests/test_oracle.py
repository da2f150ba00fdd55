"""Every registered query against its DuckDB oracle at sf0.001 (the
driver runs the same check at sf0.01)."""

import pytest

import __spark_entry__ as E
from oracle_check import check, duck

from conftest import SF_SMALL
from provenant.plans import catalog

QUERIES = E.queries()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_sql_or_is_documented():
    rows_only = set(catalog.QUERIES) - set(catalog.ORACLE_SQL)
    assert rows_only == {"content_digest_blake3", "record_build_blake3", "file_digests_blake3"}
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = check(spark, con, name, QUERIES[name], SQL.get(name), SF_SMALL)
    plan = r.pop("plan")
    assert r["status"] in ("ok", "rows-only"), r
    # scale guard: no query may pair all rows with all rows
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
