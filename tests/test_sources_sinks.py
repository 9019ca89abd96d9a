import io
import json
import math
import sqlite3

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarn.functions import format_value, histogram, physical_order, profile
from tarn.functions.formatting import format_reals
from tarn.functions.statistics import SAMPLE_ROWS, cardinality, density, value_range
from tarn.harness import QueryCase, run_cases, same_lines
from tarn.operators import Engine
from tarn.plans import scan
from tarn.sinks import result_lines, write_catalog, write_sqlite, write_text
from tarn.sources import Catalog, discover, read_delimited, read_row_blocks, write_row_block_parts, write_row_blocks
from tarn.sources.delimited import parse_schema
from tarn.streaming import run_on_batches, run_stream


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_delimited_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1|a||2.5|9\n -7|é|x|NaN||\n3|||1e3|surplus|more\n")
    (tmp_path / "t.schema").write_text("a|b|c|d|\nI32|STRING|string|FLOAT64|\n")
    (tmp_path / "alone.csv").write_text("1\n")
    found = discover(spark, str(tmp_path))
    assert list(found) == ["t"]
    got = sorted(map(tuple, read_delimited(spark, *found["t"]).collect()))
    assert [r[:3] for r in got] == [(-7, "é", "x"), (1, "a", ""), (3, "", "")]
    assert math.isnan(got[0][3]) and [r[3] for r in got[1:]] == [2.5, 1000.0]


@pytest.mark.parametrize("line", ["1", "", "1||", "x|a", "99999999999|a"])
def test_bad_lines_fail(spark, tmp_path, line):
    (tmp_path / "t.csv").write_text(f"1|a\n{line}\n")
    with pytest.raises(Exception, match="fewer than|not of type"):
        read_delimited(spark, str(tmp_path / "t.csv"), parse_schema("a|b\nI32|STRING")).collect()


def test_row_blocks(spark, tmp_path):
    path = str(tmp_path / "t.bin")
    data = [(k, k << 33, float(k) / 4, k / 3, "é" * (k % 9)) for k in range(500)]
    df = spark.createDataFrame(data, "i int, l long, f float, d double, s string").repartition(3)
    blocks = write_row_blocks(df, path, 256)
    assert (tmp_path / "t.bin").stat().st_size == blocks * 256
    assert rows(read_row_blocks(spark, path, df.schema, 256)) == data
    with pytest.raises(Exception, match="does not fit"):
        write_row_blocks(spark.createDataFrame([("x" * 300,)], "s string"), path, 256)
    with pytest.raises(ValueError, match="no such types"):
        write_row_blocks(spark.createDataFrame([(True,)], "b boolean"), path)


def test_value_text():
    import numpy as np

    cases = {2.0: "2.0", 1e22: "10000000000000000000000.0", 1e-5: "0.00001", 12345678.5: "12345678.5", -0.0: "-0.0", math.inf: "inf", -math.inf: "-inf", 7: "7", "a|b": "a|b"}
    assert {k: format_value(k) for k in cases} == cases
    assert format_value(math.nan) == "NaN.0" and format_value(float(np.float32(0.1)), single=True) == "0.1"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(), st.floats(width=32), st.floats(-1e6, 1e6), st.integers(-(10**9), 10**9).map(float)), max_size=8))
def test_columns_of_reals_equal_single_values(values):
    assert format_reals(pa.array(values, pa.float64())).to_pylist() == [format_value(v) for v in values]
    single = pa.array(np.array([0.0 if v is None else v for v in values], np.float64).astype(np.float32))
    assert format_reals(single).to_pylist() == [format_value(v, True) for v in single.to_pylist()]


def test_result_stream(spark):
    df = spark.createDataFrame([(1, "abc", 2.5, 0.1), (2, "", math.nan, 1e10)], "i int, s string, d double, f float").coalesce(1).orderBy("i")
    out = io.StringIO()
    assert write_text(df, out) == 2
    assert out.getvalue() == "1|abc|2.5|0.1|\n2||NaN.0|10000000000.0|\n!\n"
    assert list(result_lines(df.select("i", "s"))) == ["1|abc|", "2||", "!"]
    assert list(result_lines(df.limit(0))) == ["!"]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "t.db")
    data = [(k, f'it"s {k}', k / 2) for k in range(2500)]
    write_sqlite({'odd "name"': spark.createDataFrame(data, "i long, s string, d double")}, path)
    with sqlite3.connect(path) as db:
        assert sorted(db.execute('SELECT * FROM "odd ""name"""')) == data


def test_catalog_round_trip(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "i int, s string")
    text = write_catalog({"t": df})
    assert json.loads(text)["table_specs"][0]["column_specs"][0]["data_type"] == "Int32"
    opened = Catalog.from_json(text, lambda file_id, schema: spark.createDataFrame([(5, file_id)], schema))
    assert rows(Engine(opened).run(scan("t"))) == [(5, "t")]


DOCUMENT = """{"table_specs": [{"name": "t", "file_id": "f", "column_specs": [
{"column_name": "i", "data_type": "Int64", "stats": ["IsPhysicallyOrdered", {"RangeStat": {"lower_bound": {"Int64": 4611686018427387905}, "upper_bound": {"Int64": 4611686018427387907}}},
 {"CardinalityStat": 2}, {"DensityStat": 1.0}, {"HistogramStat": {"frequency_points": [[{"lower_bound": {"Int64": 4611686018427387905}, "upper_bound": {"Int64": 4611686018427387905}}, 1],
 [{"lower_bound": {"Int64": 4611686018427387907}, "upper_bound": {"Int64": 4611686018427387907}}, 1]]}}]},
{"column_name": "s", "data_type": "String", "stats": null}]}]}"""


def test_catalog_statistics_in_the_tagged_form(spark, tmp_path):
    low, high = 4611686018427387905, 4611686018427387907
    want = {"IsPhysicallyOrdered": True, "RangeStat": (low, high), "CardinalityStat": 2, "DensityStat": 1.0, "HistogramStat": [(low, low, 1), (high, high, 1)]}
    assert Catalog.from_json(DOCUMENT, lambda *_: None).statistics == {"f": {"i": want, "s": {}}}
    path = str(tmp_path / "t")
    spark.createDataFrame([(low, "a", 0.1), (high, "a", 0.5)], "i long, s string, x float").coalesce(1).write.parquet(path)
    text = write_catalog({"f": spark.read.parquet(path)})
    stats = Catalog.from_json(text, lambda *_: None).statistics["f"]
    assert stats["i"] == want
    assert stats["s"]["HistogramStat"] == [("a", "a", 1), ("a", "a", 1)] and "RangeStat" not in stats["s"]
    assert json.loads(text)["table_specs"][0]["column_specs"][0]["stats"] == json.loads(DOCUMENT)["table_specs"][0]["column_specs"][0]["stats"]
    assert [round(v, 6) for v in stats["x"]["RangeStat"]] == [0.1, 0.5]
    with pytest.raises(ValueError):
        Catalog.from_json(DOCUMENT.replace("CardinalityStat", "OtherStat"), lambda *_: None)
    with pytest.raises(ValueError):
        Catalog.from_json(DOCUMENT.replace('"Int64": 46', '"Int16": 46'), lambda *_: None)


def test_row_block_parts(spark, tmp_path):
    df = spark.range(5000).selectExpr("id", "cast(id as int) i", "id / 3 d", "cast(id / 7 as float) f").repartition(3)
    folder = str(tmp_path / "blocks")
    n = write_row_block_parts(df, folder)
    files = sorted(p.name for p in (tmp_path / "blocks").iterdir())
    assert files == [f"part-0000{k}.bin" for k in range(3)] and sum((tmp_path / "blocks" / f).stat().st_size for f in files) == 4096 * n
    assert rows(read_row_blocks(spark, folder, df.schema)) == rows(df)
    texts = df.selectExpr("id", "concat('é ', id) s")
    write_row_block_parts(texts, str(tmp_path / "texts"))
    assert rows(read_row_blocks(spark, str(tmp_path / "texts"), texts.schema)) == rows(texts)
    assert write_row_block_parts(df.limit(0), str(tmp_path / "none")) == 0


def test_statistics_by_hand(spark):
    df = spark.createDataFrame([(3, "a", 1.0), (1, "a", 1.0), (2, "b", 5.0), (2, "b", 5.0)], "i int, s string, d double")
    assert rows(value_range(df)) == [("d", "double", None, None, 1.0, 5.0), ("i", "int", 1, 3, None, None)]
    assert rows(cardinality(df)) == [("d", 2), ("i", 3), ("s", 2)]
    assert rows(density(df)) == [("d", 0.5), ("i", 0.75), ("s", 0.5)]
    assert rows(histogram(df.select("i"))) == [("i", 0, "1", "1", 1), ("i", 1, "2", "2", 1), ("i", 2, "2", "2", 1), ("i", 3, "3", "3", 1)]
    assert set(profile(df)) == {"i", "s", "d"}
    assert rows(cardinality(df, exact=True)) == rows(cardinality(df)) and rows(density(df, exact=True)) == rows(density(df))
    empty = df.limit(0)
    assert not any(f(empty).count() for f in (value_range, cardinality, density, histogram))
    wide = spark.createDataFrame([((1 << 62) + 1, 0.1)], "k long, f float")
    assert rows(value_range(wide.select("k"))) == [("k", "bigint", (1 << 62) + 1, (1 << 62) + 1, None, None)]


def test_large_columns(spark):
    n = 30_000
    df = spark.range(n).selectExpr("id", "cast(id % 60 as string) many", "cast(id % 40 as string) few")
    counts = dict(rows(cardinality(df)))
    assert counts["many"] == 60 and counts["few"] == 40 and abs(counts["id"] - n) < 0.1 * n
    buckets = rows(histogram(df))
    assert {b[0] for b in buckets} == {"id", "few"} and len(buckets) == 20
    assert sum(b[4] for b in buckets if b[0] == "id") == n == 3 * SAMPLE_ROWS


def test_exact_histogram_over_ranges(spark, monkeypatch):
    import tarn.functions.statistics as s

    monkeypatch.setattr(s, "CHUNK_ROWS", 1000)
    n = 30_011
    hot = "case when id < 12000 then 500 when id % 11 = 0 then null else id * 7919 % 30011 end"
    df = spark.range(n).selectExpr(f"{hot} i", "case when id % 9 = 0 then double('NaN') else id % 4001 / 4 - 100 end x", "string(id % 3) few", "string(id) many", "float(null) none")
    got = histogram(df, exact=True).collect()
    data, depth = df.collect(), -(-n // 10)
    for name in ("i", "x", "few", "none"):
        column = sorted((r[name] for r in data), key=lambda v: (v is None, v is not None and v != v, 0 if v is None or v != v else v))
        want = []
        for k in range(0, n, depth):
            part = column[k : k + depth]
            values = [v for v in part if v is not None] or [None]
            want.append((name, k // depth, *(None if v is None else "NaN" if v != v else str(v) for v in (values[0], values[-1])), len(part)))
        assert sorted(tuple(r) for r in got if r["column_name"] == name) == want
    assert {r["column_name"] for r in got} == {"i", "x", "few", "none"}
    assert rows(histogram(df.select("i").limit(3), exact=True)) == [("i", k, "500", "500", 1) for k in range(3)]
    assert histogram(df.limit(0), exact=True).count() == 0


def test_physical_order_across_files_and_chunks(spark, tmp_path, monkeypatch):
    import tarn.functions.statistics as s

    monkeypatch.setattr(s, "CHUNK_ROWS", 7)
    for k in range(3):
        spark.range(k * 50, k * 50 + 50).selectExpr("id up", "-id down", "id % 50 saw", "1 same").coalesce(1).write.parquet(str(tmp_path / f"part={k}"))
    df = spark.read.parquet(*(str(tmp_path / f"part={k}") for k in range(3)))
    assert dict(rows(physical_order(df))) == {"up": True, "down": False, "saw": False, "same": True}
    spark.createDataFrame([], "i int").write.parquet(str(tmp_path / "none"))
    assert physical_order(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_harness(spark, tmp_path):
    engine = Engine({"t": spark.createDataFrame([(2,), (1,)], "i int").coalesce(1)})
    (tmp_path / "want").write_text("1|\n2|\n!\n")
    file = str(tmp_path / "want")
    cases = [QueryCase("sorted", scan("t").sort("i"), file), QueryCase("any", scan("t"), file, ordered=False), QueryCase("wrong", scan("t").filter("i", "GT", 1), file), QueryCase("off", scan("t"), file, disabled=True), QueryCase("bad", "{}", file)]
    outcomes = run_cases(engine, cases, str(tmp_path / "failures"))
    assert [o.status for o in outcomes] == ["passed", "passed", "failed", "skipped", "failed"]
    assert (tmp_path / "failures").read_text().count("\n") == 2
    assert same_lines(["a"], ["a", "b"], True) == "1 lines instead of 2"


def test_streaming_plans(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(k, k % 3) for k in range(30)], "k long, g int").write.parquet(source)
    stream = spark.readStream.schema("k long, g int").parquet(source)
    static = {"names": spark.createDataFrame([(0, "zero"), (1, "one")], "id int, name string")}
    plan = scan("s").hash_join(scan("names"), "g", "id").filter("k", "LT", 10).project("k", "name")
    query = run_stream(plan, {"s": stream, **static}).writeStream.format("memory").queryName("out").start()
    query.processAllAvailable()
    query.stop()
    want = [(k, ("zero", "one")[k % 3]) for k in range(10) if k % 3 < 2]
    assert rows(spark.table("out")) == want
    with pytest.raises(ValueError):
        run_stream(plan.sort("k"), {"s": stream, **static})
    got = []
    query = run_on_batches(plan.sort(("k", False)), "s", stream, static, lambda df, _: got.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert got == want[::-1]
