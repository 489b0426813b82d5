"""Every registered query of the reference part runs, and equals its SQL on DuckDB where it has one."""

import duckdb
import pytest

from docket.plans import audit, catalogue, desk, dims, flow, records, streams, surfaces  # noqa: F401  (they register their queries in the catalogue)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got
    if name in catalogue.ORACLE_SQL:
        rows = duck.execute(catalogue.ORACLE_SQL[name])
        names = [d[0] for d in rows.description]
        assert sorted(names) == columns
        want = [tuple(r[names.index(c)] for c in columns) for r in rows.fetchall()]
        key = lambda r: tuple((v is None, str(v)) for v in r)
        assert sorted(got, key=key) == sorted(want, key=key)


def test_oracles_have_queries():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
