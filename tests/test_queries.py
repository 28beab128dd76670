"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from rowforge.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{SF}/{f}')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6g}" if v != int(v) else str(int(v))
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if hasattr(v, "is_finite"):
        return plain(float(v))
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    if name in registry.ORACLES:
        c = duck.execute(registry.ORACLES[name])
        assert got == table([d[0] for d in c.description], c.fetchall())
