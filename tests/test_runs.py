"""Whole runs from a source to files, and sources that need no engine of their own."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from citeloom.plans import runs
from citeloom.session import materialize, tables_removed, work_dir
from citeloom.sources import readers, sinks

ROWS = [
    ("10.1/aaaaaaaa", "Tides", "2019", "moon; sand", "A; B", "DOI 10.1/bbbbbbbb; DOI 10.1/cccccccc"), ("10.1/bbbbbbbb", "Tides", "2020", "moon; tides", "B; C", "DOI 10.1/cccccccc"),
    ("10.1/cccccccc", "Waves", "2021", "moon; sand; foam", "A; C", None), (None, "Waves", "2021", "sand", "A", "doi:10.1/aaaaaaaa"), ("10.1/dddddddd", "Proc. of Foam", "2021", "foam", "A", None),
    ("10.1/eeeeeeee", "Tides", "n.d.", "sand", "B", "DOI 10.1/bbbbbbbb"),
]
ALIASES = {"DOI": ["DOI"], "Source Title": ["Title of Source"], "Publication Year": ["Year"], "Keywords": ["Keywords"], "WoS Categories": ["WoS Categories"], "Cited References": ["Refs"]}
HEADER = ["DOI", "Title of Source", "Year", "Keywords", "WoS Categories", "Refs"]


def workbook(path, header, rows):
    """A minimal workbook: shared strings in the header, inline strings and numbers below."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    cell = lambda c, r, v: "" if v is None else f'<c r="{c}{r}"><v>{v}</v></c>' if v.isdigit() else f'<c r="{c}{r}" t="inlineStr"><is><t>{v}</t></is></c>'
    lines = [f'<row r="1">{"".join(f"<c r={chr(34)}{chr(65 + k)}1{chr(34)} t={chr(34)}s{chr(34)}><v>{k}</v></c>" for k in range(len(header)))}</row>']
    lines += [f'<row r="{n}">{"".join(cell(chr(65 + k), n, v) for k, v in enumerate(row))}</row>' for n, row in enumerate(rows, 2)]
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/sharedStrings.xml", f'<sst {main}>{"".join(f"<si><t>{h}</t></si>" for h in header)}</sst>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(lines)}</sheetData></worksheet>")


@pytest.fixture(scope="module")
def cleaned(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("excel")
    workbook(folder / "a.xlsx", HEADER, ROWS[:3])
    workbook(folder / "b 2.xlsx", ["Other", *HEADER], [("x", *r) for r in ROWS[3:]])
    workbook(folder / "none.xlsx", ["Other"], [("x",)])
    (folder / "broken.xlsx").write_text("no workbook")
    config = {"data_source": {"type": "excel", "excel_dir": str(folder)}, "cleaning": {"drop_conference": True, "top_n": 1}, "field_mapping": ALIASES}
    return folder, runs.clean_export(spark, config, str(folder / "out"))


def test_excel_files(spark, cleaned):
    got = readers.read_excel_folder(spark, str(cleaned[0]), ALIASES)
    assert got.columns == [*HEADER, "source_file"]
    assert {tuple(r) for r in got.collect()} == {(*r, "a.xlsx") for r in ROWS[:3]} | {(*r, "b 2.xlsx") for r in ROWS[3:]}


def test_cleaning_run(spark, cleaned):
    background, target = (readers.read_csv(spark, p) for p in cleaned[1])
    assert {r.DOI for r in background.collect()} == {r[0] for r in ROWS} - {"10.1/dddddddd"}
    assert {r["Source Title"] for r in target.collect()} == {"Tides"} and target.count() == 3
    assert {r.DOI: json.loads(r.citing) for r in background.collect()}["10.1/aaaaaaaa"] == ["10.1/bbbbbbbb", "10.1/cccccccc"]
    with pytest.raises(ValueError):
        runs.clean_export(spark, {"data_source": {"type": "tape"}, "cleaning": {}, "field_mapping": {}}, "/nowhere")


def test_runs_and_their_files(spark, cleaned, tmp_path):
    background, target = (readers.read_csv(spark, p) for p in cleaned[1])
    with tables_removed(spark):
        found = runs.disruption(background, target)
        d = {r.id: (r.ni, r.nj, r.nk) for r in found["scores"].collect()}
        # b is cited by a (which cites c too) and e, and cites c itself; a is cited by the paper without an identifier, which isn't in the graph.
        assert d == {"10.1/aaaaaaaa": (0, 0, 3), "10.1/bbbbbbbb": (1, 1, 1), "10.1/eeeeeeee": (0, 0, 2)}
        runs.save(found, str(tmp_path / "d"))
        for by_doi in (False, True):
            new = runs.pair_novelty(background, target, by_doi)
            assert {r.periodical for r in new["ranking"].collect()} == {"Tides"}
        runs.save(new, str(tmp_path / "n"), decimals=2)
        runs.save(runs.category_diversity(background, target), str(tmp_path / "t"))
        ku = runs.category_similarity(background, target)
        assert ku["ranking"].first().periodical == "Tides"
        runs.save(ku, str(tmp_path / "k"))
        fields = spark.createDataFrame([("sea", "tides"), ("sky", "moon"), ("sea", "sands")], "field string, term string")
        e = runs.field_entropy(target, fields)
        assert [(r.periodical, round(r.entropy_mean, 6), r.n_papers) for r in e["ranking"].collect()] == [("Tides", round(2 / 3, 6), 3)]
        assert runs.field_entropy(background.withColumn("Abstract", F.lit("moon moon tides")), fields, "both")["ranking"].count() == 2
        runs.save(e, str(tmp_path / "e"))
        runs.save(runs.keyword_themes(target, 2), str(tmp_path / "w"))
    assert (tmp_path / "d" / "mean.txt").read_text().split() == ["Tides"] and "<svg" in (tmp_path / "d" / "enhanced.svg").read_text()
    assert json.loads((tmp_path / "w" / "keywords.json").read_text())["data"]["Tides"]["keywords"][2] == "tides"
    assert (tmp_path / "k" / "categories.csv").exists() and (tmp_path / "t" / "similarity.csv").exists() and (tmp_path / "d" / "network" / "edges").exists()


def test_databases_are_read_in_parallel(spark, monkeypatch):
    monkeypatch.setitem(readers.DIALECTS, "derby", "jdbc:derby:memory:{database};create=true")
    df = spark.createDataFrame([(n, f"t{n}", "x") for n in range(50)], "N int, PERIODICAL string, OTHER string")
    df.write.jdbc("jdbc:derby:memory:runs;create=true", "papers", properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    database = {"dialect": "derby", "database": "runs", "table": "papers", "driver": "org.apache.derby.jdbc.EmbeddedDriver", "partitionColumn": "N", "numPartitions": 4}
    got = readers.read_database(spark, database, {"Source Title": ["periodical"]})
    assert got.columns == ["PERIODICAL"] and {r[0] for r in got.collect()} == {f"t{n}" for n in range(50)} and got.rdd.getNumPartitions() == 4
    assert readers.read_database(spark, database | {"partitionColumn": None}, {"x": ["none"]}).columns == ["N", "PERIODICAL", "OTHER"]


def test_charts(spark, tmp_path):
    df = spark.createDataFrame([("a & b", 2.0), ("c", -1.0), ("d", None)], "periodical string, s double")
    for vertical in (False, True):
        sinks.write_bars(df, str(tmp_path / "c.svg"), "periodical", "s", "<t>", vertical)
        text = (tmp_path / "c.svg").read_text()
        assert text.count("<rect") == 3 and "a &amp; b" in text and "&lt;t&gt;" in text
    sinks.write_bars(df.limit(0), str(tmp_path / "e.svg"), "periodical", "s")


def test_tables_go_with_their_block(spark):
    import os

    root = work_dir(spark).removeprefix("file://")
    with tables_removed(spark):
        table = materialize(spark.range(3))
        path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert table.count() == 3 and path.startswith(root) and os.path.exists(path)
    assert not os.path.exists(path)
