"""Every core query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from inkwright.plans import load
from tests.conftest import SF

CORE = load()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_sql(spark, duck, name):
    df = CORE.queries[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(CORE.sql[name])
    names = [d[0] for d in r.description]
    want = sorted((tuple(plain(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=repr)
    assert sorted(names) == cols and got == want


@pytest.mark.parametrize("name", sorted(set(CORE.queries) - set(CORE.sql)))
def test_runs(spark, name):
    assert CORE.queries[name](spark, SF).count() > 0
