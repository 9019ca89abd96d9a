import duckdb
import pytest

from tarn.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    base = duckdb.connect()
    for table in ("documents", "benchmark"):
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    got = QUERIES[name](spark, SF).toPandas()
    want = base.execute(ORACLE_SQL[name]).df()[list(got.columns)]
    assert list(map(str, got.dtypes)) == list(map(str, want.dtypes))
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, want.to_numpy().tolist()))
