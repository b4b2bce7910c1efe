"""Every registered query against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from loomspark.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations events".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    names = ", ".join(f'"{c}"' for c in columns)
    expected = duck.sql(f"select {names} from ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted(plain(tuple(r)) for r in got.select(*columns).collect()) == sorted(map(plain, expected))


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
