import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tarn import workload

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in workload.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(workload.ORACLE_SQL))
def test_queries_equal_their_sql(spark, db, name):
    got = workload.QUERIES[name](spark, SF)
    want = db.sql(workload.ORACLE_SQL[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    text = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert text(got.select(*order).collect()) == text(want.select(", ".join(f'"{c}"' for c in order)).fetchall())


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    """A folder of 30,000 customers and suppliers, more than estimates and samples begin at, and its views."""
    folder = str(tmp_path_factory.mktemp("large"))
    balance = "case id % 5 when 0 then null when 1 then double('NaN') when 2 then -0.0D when 3 then 0.0D else id / 7 end"
    spark.range(30_000).selectExpr("id * 7 % 30000 c_custkey", "concat('c', id % 20011) c_name", "cast(id % 25 as int) c_nationkey", f"{balance} c_acctbal", "string(id % 3) c_mktsegment").write.parquet(f"{folder}/customer.parquet")
    spark.range(30_000).selectExpr("id * 7 % 30000 s_suppkey", "concat('s', id) s_name", "cast(if(id % 3 = 0, null, if(id % 3 = 1, 4, id % 25)) as int) s_nationkey", f"{balance} s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    con = duckdb.connect()
    for t in ("customer", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", ["stats_cardinality", "stats_density", "stats_histogram"])
def test_large_tables_equal_their_sql(spark, large, name):
    folder, con = large
    got, want = workload.QUERIES[name](spark, folder), con.sql(workload.ORACLE_SQL[name])
    order = sorted(want.columns)
    text = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert text(got.select(*order).collect()) == text(want.select(", ".join(order)).fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_removable_parts(tmp_path):
    code = "import sys; sys.modules['tarn.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=os.path.dirname(__spark_entry__.__file__), check=True)
    assert int(out.stdout) == len(workload.QUERIES)
