"""Every query with SQL gives DuckDB's rows at the smallest scale; every other one runs."""

import decimal
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from litspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def results(spark, request):
    """Columns and rows of all chosen queries, which run side by side, since most of their time is planning."""

    def run(name):
        df = registry.queries()[name](spark, SF)
        cols = sorted(df.columns)
        return cols, sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())

    names = [i.callspec.params["name"] for i in request.session.items if i.module is request.module]
    with ThreadPoolExecutor(8) as pool:
        return {name: pool.submit(run, name) for name in names}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(results, duck, name):
    cols, got = results[name].result()
    if sql := registry.oracle_sql().get(name):
        r = duck.sql(sql)
        at = [r.columns.index(c) for c in cols]
        assert sorted(r.columns) == cols
        assert got == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())
