"""Every registered query of the engine against its oracle on the smallest tables."""

import math

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    from tessera.sources.tables import NAMES

    c = duckdb.connect()
    for t in NAMES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=str)
    if name not in registry.ORACLE:
        assert got
        return
    want = con.sql(registry.ORACLE[name])
    assert sorted(want.columns) == cols
    want = sorted(con.sql(f"select {', '.join(cols)} from ({registry.ORACLE[name]})").fetchall(), key=str)
    assert len(got) == len(want) and all(same(x, y) for r, s in zip(got, want) for x, y in zip(r, s))
