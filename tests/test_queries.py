"""Every registered query of the core against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from larkspur.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, names):
    out = []
    for r in rows:
        out.append(tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 6) if isinstance(v, float) else v for v in (r[n] for n in names)))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, sql, name):
    got = registry.QUERIES[name](spark, SF)
    want = sql.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    have = plain([r.asDict() for r in got.collect()], names)
    need = plain([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], names)
    assert have == need


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
