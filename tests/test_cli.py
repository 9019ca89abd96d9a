import json
import sqlite3

from tarn.__main__ import main
from tarn.plans import scan, to_json
from tarn.sources import Catalog, read_row_blocks


def test_compile_and_query(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("2|b|0.5|\n1|a|1|\n")
    (tmp_path / "t.schema").write_text("k|s|x\nI32|STRING|FLOAT64\n")
    query = tmp_path / "q.json"
    query.write_text(to_json(scan("t").sort("k").project("x", "s")))
    assert main(["show", str(query)]) == 0 and json.loads(capsys.readouterr().out)["root"]
    assert main(["query", str(query), "--tables", str(tmp_path)]) == 0
    assert capsys.readouterr().out == "1.0|a|\n0.5|b|\n!\n"
    out = tmp_path / "out"
    assert main(["all", "--tables", str(tmp_path), "--out", str(out)]) == 0
    with sqlite3.connect(out / "tables.db") as db:
        assert sorted(db.execute("SELECT * FROM t")) == [(1, "a", 1.0), (2, "b", 0.5)]
    catalog = Catalog.from_json((out / "catalog.json").read_text(), lambda t, schema: read_row_blocks(spark, str(out / f"{t}.bin"), schema))
    assert sorted(map(tuple, catalog["t"].collect())) == [(1, "a", 1.0), (2, "b", 0.5)]
    assert main(["query", str(query), "--config", str(out / "catalog.json")]) == 0
    assert capsys.readouterr().out == "1.0|a|\n0.5|b|\n!\n"
