"""Every registered query against its SQL, over whole tables."""

import os

import duckdb
import pytest

from tidemark import plans

SF = os.environ.get("TIDEMARK_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect(config={"memory_limit": "3GB", "threads": 4})  # one statement cannot end the run
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM read_parquet('{SF}/{f}')")
    return c


def rows(columns, data):
    order = [columns.index(c) for c in sorted(columns)]
    tidy = [tuple(round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order) for r in data]
    return sorted(tidy, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got = plans.queries()[name](spark, SF)
    want = duck.sql(plans.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    plans.queries()[name](spark, SF).collect()
