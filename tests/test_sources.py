import json

import pytest

from citeloom.sources import readers, sinks


def test_csv_there_and_back(spark, tmp_path):
    df = spark.createDataFrame([("Größe, \"x\"\nline", 1.23456, None), ("b", 2.0, "n")], "periodical string, score double, note string")
    path = str(tmp_path / "out.csv")
    sinks.write_csv(df, path, decimals=2)
    assert open(path, "rb").read().startswith(b"\xef\xbb\xbf")
    back = readers.read_csv(spark, path)
    assert back.columns == ["periodical", "score", "note"]
    assert [tuple(r) for r in back.collect()] == [("Größe, \"x\"\nline", "1.23", None), ("b", "2.00", "n")]


def test_json_list_matrix_network(spark, tmp_path):
    df = spark.createDataFrame([("é", 0.5), ("b", 0.25)], "periodical string, score double")
    sinks.write_scores_json(df, str(tmp_path / "s.json"), "periodical", "score")
    assert json.loads((tmp_path / "s.json").read_text()) == {"é": 0.5, "b": 0.25}
    sinks.write_themes_json(df, str(tmp_path / "t.json"), "x.csv")
    assert json.loads((tmp_path / "t.json").read_text())["metadata"] == {"source_file": "x.csv", "total_periodicals": 2}
    sinks.write_list(df, str(tmp_path / "l.txt"))
    assert (tmp_path / "l.txt").read_text() == "é\nb\n"
    cells = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.5)], "i string, j string, s double")
    sinks.write_matrix(cells, str(tmp_path / "m.csv"))
    assert (tmp_path / "m.csv").read_text(encoding="utf-8-sig").split() == [",a,b", "a,1.0,0.5", "b,0.0,0.0"]
    sinks.write_network(df, cells, str(tmp_path / "net"))
    assert spark.read.json(str(tmp_path / "net/edges")).count() == 2
    counts = {r.extension: r.n_files for r in sinks.inventory(spark, str(tmp_path)).collect()}
    assert counts[".csv"] == 1 and counts[".txt"] == 1


def test_databases():
    got = readers.jdbc_options({"dialect": "postgresql", "host": "h", "port": 5, "database": "d", "table": "t", "user": "u"})
    assert got == {"url": "jdbc:postgresql://h:5/d", "dbtable": "t", "user": "u"}
    assert readers.jdbc_options({"dialect": "sqlite", "database": "f", "table": "t", "sql": "select 1"})["query"] == "select 1"
    for bad in ({"dialect": "other", "table": "t"}, {"dialect": "mysql"}):
        with pytest.raises(ValueError):
            readers.jdbc_options(bad)


def test_empty_excel_folder(spark, tmp_path):
    (tmp_path / "broken.xls").write_text("no workbook")
    with pytest.raises(ValueError):
        readers.read_excel_folder(spark, str(tmp_path), {"DOI": ["DOI"]})
