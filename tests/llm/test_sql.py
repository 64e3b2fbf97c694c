"""Registered operator queries against their SQL on the smallest tables."""

import duckdb
import pytest

from larkspur.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    need = sorted(map(str, (tuple(dict(zip(want.columns, r, strict=True))[n] for n in names) for r in want.fetchall())))
    assert sorted(map(str, (tuple(r[n] for n in names) for r in got.collect()))) == need


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_every_row_has_a_result(spark, name):
    got = QUERIES[name](spark, SF)
    source = spark.read.parquet(f"{SF}/{'embeddings' if name.startswith('op2_') else 'documents'}.parquet")
    key = source.columns[0]
    assert got.select(key).distinct().count() == source.count()
