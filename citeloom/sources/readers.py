"""Scans (OP-01 to OP-04)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.ingest import find_column, map_columns
from citeloom.session import materialize

#: The paper export; every field as typed, to be parsed by the operators.
PAPER_EXPORT = T.StructType([T.StructField(n, T.StringType()) for n in ("DOI", "Source Title", "Publication Year", "Keywords", "WoS Categories", "citing", "Cited References", "Article Title", "Abstract", "Affiliations")])
DIALECTS = {"mysql": "jdbc:mysql://{host}:{port}/{database}", "postgresql": "jdbc:postgresql://{host}:{port}/{database}", "sqlite": "jdbc:sqlite:{database}"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """OP-01: a CSV export with a header; text fields may hold line ends and doubled quotes. The schema is fixed, never inferred.

    Without `schema` the header's columns are read as strings. Empty fields are null, as
    a CSV file doesn't tell the two apart. A byte order mark is no part of the first name.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("﻿")) if first.startswith("﻿") else df


def _cell_column(reference: str) -> int:
    """Column number of a cell reference like `BC12`."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _workbook_rows(content: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet of an `.xlsx` workbook, every cell as text."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = book.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iter(f"{space}t")) for item in root.iter(f"{space}si")]
        sheet = min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        with book.open(sheet) as text:
            for _, row in ElementTree.iterparse(text):
                if row.tag != f"{space}row":
                    continue
                cells: dict[int, str] = {}
                for k, cell in enumerate(row.iter(f"{space}c")):
                    kind, value = cell.get("t", "n"), cell.findtext(f"{space}v")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{space}t"))
                    elif value is not None and kind == "s":
                        value = shared[int(value)]
                    elif value is not None and kind == "b":
                        value = str(value == "1")
                    if value is not None and kind != "e":
                        cells[_cell_column(cell.get("r", "")) if cell.get("r") else k] = value
                yield [cells.get(k) for k in range(max(cells, default=-1) + 1)]
                row.clear()


def read_excel_folder(spark: SparkSession, folder: str, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """OP-02: all `*.xls*` files of a folder, columns with an exactly known name only, and source_file.

    Files are read by the executors, one task's work each: `.xlsx` with the standard library, older ones
    with an Excel engine of pandas where there is one. Files without a known column and unreadable files
    are skipped; none at all raises. Of equal column names in a file the last counts.
    """
    known = {a for names in aliases.values() for a in names}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                name = unquote(path.rsplit("/", 1)[-1])
                try:
                    if name.lower().endswith(".xls"):
                        sheet = pd.read_excel(io.BytesIO(content), dtype=str, header=None)
                        rows = iter(sheet.astype(object).where(sheet.notna(), None).values.tolist())
                    else:
                        rows = _workbook_rows(content)
                    at = {k: c for k, c in enumerate(next(rows, [])) if c in known}
                    out = [{c: row[k] for k, c in at.items() if k < len(row) and row[k] is not None} for row in rows] if at else []
                except Exception as e:
                    print(f"skipped {name}: {e}")
                    continue
                if at:
                    header = [{"source_file": name, "header": list(at.values()), "cells": None}]
                    yield pd.DataFrame(header + [{"source_file": name, "header": None, "cells": r} for r in out if r])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls*").load(folder).select("path", "content")
    read = materialize(files.repartition(max(1, files.select("path").count())).mapInPandas(run, "source_file string, header array<string>, cells map<string,string>"))
    found = {r[0] for r in read.select(F.explode("header")).distinct().collect()}  # known names only
    if not found:
        raise ValueError(f"no readable file in {folder}")
    names = [a for aliases_ in aliases.values() for a in dict.fromkeys(aliases_) if a in found]
    return read.where("cells is not null").select(*(F.col("cells")[a].alias(a) for a in dict.fromkeys(names)), "source_file")


def jdbc_options(database: Mapping[str, object]) -> dict[str, str]:
    """Options of the JDBC reader; `sql` beats `table`, neither raises, an unknown dialect raises."""
    dialect = str(database.get("dialect", ""))
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect {dialect!r}")
    options = {"url": DIALECTS[dialect].format(host=database.get("host", "localhost"), port=database.get("port", ""), database=database.get("database", ""))}
    options |= {k: str(database[k]) for k in ("user", "password", "driver", "fetchsize", "partitionColumn", "lowerBound", "upperBound", "numPartitions") if database.get(k)}
    if database.get("sql"):
        return options | {"query": str(database["sql"])}
    if database.get("table"):
        return options | {"dbtable": str(database["table"])}
    raise ValueError("neither sql nor table is given")


def read_database(spark: SparkSession, database: Mapping[str, object], aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """OP-03: a table or query; only columns with a known alias if there are any. Spark pushes the column list and filters down.

    With a partitionColumn the table is read in parallel; bounds that aren't given are asked of the database.
    """
    options = jdbc_options(database)
    if "partitionColumn" in options and "lowerBound" not in options:
        ends = spark.read.format("jdbc").options(**{k: v for k, v in options.items() if k not in ("partitionColumn", "numPartitions")}).load()
        low, high = ends.agg(F.min(options["partitionColumn"]), F.max(options["partitionColumn"])).first()
        options |= {"lowerBound": str(low or 0), "upperBound": str(high or 0), "numPartitions": options.get("numPartitions", "16")}
    df = spark.read.format("jdbc").options(**options).load()
    known = [c for names in aliases.values() if (c := find_column(df.columns, names))]
    return df.select(*(F.col(f"`{c}`") for c in dict.fromkeys(known))) if known else df


def read_papers(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """Any scan with its columns under their target names."""
    return map_columns(df, aliases)


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """OP-04."""
    df = spark.read.parquet(path)
    return df.select(*(F.col(f"`{c}`") for c in columns)) if columns else df
