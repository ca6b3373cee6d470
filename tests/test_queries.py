"""Every catalog query against its SQL in DuckDB on the same tables."""

import os
from pathlib import Path

import duckdb
import pytest

from stowage.plans.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in sorted(Path(SF).iterdir()):
        con.execute(f"CREATE VIEW {f.name.split('.')[0]} AS SELECT * FROM '{f}'")
    return con


def rows(records):
    return sorted(repr(tuple(r)) for r in records)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(got.select(columns).collect()) == rows(want.fetchall())
