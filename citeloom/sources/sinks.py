"""Sinks (OP-05 to OP-11). Files of one piece are for results of one row per periodical; large results are written by Spark."""

from __future__ import annotations

import csv
import json
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: More rows than this don't go into a file of one piece.
MOST_ROWS = 1_000_000


def _small(df: DataFrame) -> list:
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows; write them with Spark")
    return rows


def write_csv(df: DataFrame, path: str, decimals: int | None = None) -> None:
    """OP-05: one CSV file with a byte order mark and a header, in the order of `df`; nulls are empty."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for row in _small(df):
            out.writerow(["" if v is None else f"{v:.{decimals}f}" if decimals is not None and isinstance(v, float) else v for v in row])


def write_large_csv(df: DataFrame, path: str) -> None:
    """OP-05 for tables of any size: CSV files in a folder, by Spark, white space kept; read back by `read_csv`."""
    writer = df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_scores_json(df: DataFrame, path: str, key: str, value: str) -> None:
    """OP-06: {key: value}, not escaped, indented."""
    Path(path).write_text(json.dumps({r[key]: r[value] for r in _small(df)}, ensure_ascii=False, indent=2), encoding="utf-8")


def write_themes_json(df: DataFrame, path: str, source_file: str) -> None:
    """OP-06: {metadata: {source_file, total_periodicals}, data: {periodical: ...}}."""
    data = {r["periodical"]: {k: v for k, v in r.asDict().items() if k != "periodical"} for r in _small(df)}
    Path(path).write_text(json.dumps({"metadata": {"source_file": source_file, "total_periodicals": len(data)}, "data": data}, ensure_ascii=False, indent=2), encoding="utf-8")


def write_list(df: DataFrame, path: str, column: str = "periodical") -> None:
    """OP-07: one value a line, in the order of `df`."""
    Path(path).write_text("".join(f"{r[column]}\n" for r in _small(df)), encoding="utf-8")


def write_network(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """OP-08: nodes and edges as JSON lines, by Spark, so that their number doesn't matter."""
    nodes.write.mode("overwrite").json(f"{folder}/nodes")
    edges.write.mode("overwrite").json(f"{folder}/edges")


def write_matrix(cells: DataFrame, path: str, value: str = "s") -> None:
    """OP-09: cells (i, j, value) as a labelled square, 0 where there is none."""
    rows = _small(cells.select("i", "j", value))
    names = sorted({r["i"] for r in rows} | {r["j"] for r in rows})
    known = {(r["i"], r["j"]): r[value] for r in rows}
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(["", *names])
        out.writerows([a, *(known.get((a, b), 0.0) for b in names)] for a in names)


def write_bars(df: DataFrame, path: str, name: str, value: str, title: str = "", vertical: bool = False) -> None:
    """OP-10: a bar chart of a ranking with values at the bars; `.svg` is written as it is, other formats need matplotlib."""
    rows = [(str(r[0]), float(r[1] or 0)) for r in _small(df.select(name, value))]
    if path.endswith(".svg"):
        Path(path).write_text(_svg_bars(rows, title, vertical), encoding="utf-8")
        return
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot as plt

    long = 0.4 * len(rows) + 1
    fig, ax = plt.subplots(figsize=(long, 6) if vertical else (9, long))
    bars = (ax.bar if vertical else ax.barh)([r[0] for r in rows], [r[1] for r in rows])
    ax.bar_label(bars, fmt="%.4g")
    if vertical:
        ax.tick_params(axis="x", rotation=60)
    else:
        ax.invert_yaxis()
    ax.set_title(title)
    fig.savefig(path, bbox_inches="tight")
    plt.close(fig)


def _svg_bars(rows: list[tuple[str, float]], title: str, vertical: bool) -> str:
    """Bars of one colour from a common zero, labels at their feet, values at their heads."""
    text, bar, length = 260, 24, 420
    most, least = max([v for _, v in rows] + [0.0]), min([v for _, v in rows] + [0.0])
    scale = length / ((most - least) or 1.0)
    zero = -least * scale
    out = []
    for k, (label, v) in enumerate(rows):
        at, size, start = k * bar + 40, abs(v) * scale, zero + min(v, 0.0) * scale
        label, shown = escape(label), f"{v:.4g}"
        if vertical:
            x, y = at, 40 + length - start - size
            out.append(f'<rect x="{x}" y="{y:.1f}" width="{bar - 6}" height="{size:.1f}"/><text x="{x}" y="{y - 4:.1f}">{shown}</text><text transform="translate({x + 4},{length + 56}) rotate(60)">{label}</text>')
        else:
            x, y = text + start, at
            out.append(f'<rect x="{x:.1f}" y="{y}" width="{size:.1f}" height="{bar - 6}"/><text x="{x + size + 4:.1f}" y="{y + 13}">{shown}</text><text x="{text - 6}" y="{y + 13}" text-anchor="end">{label}</text>')
    long = len(rows) * bar + 60
    wide, high = (long + 60, length + 60 + text) if vertical else (text + length + 80, long)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide}" height="{high}" font-family="sans-serif" font-size="12" fill="#333"><text x="10" y="20" font-size="15">{escape(title)}</text><g fill="#4a7ab5">{"".join(out)}</g></svg>'


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """OP-11: (extension, n_files, n_bytes) of a folder and all below it, most files first; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.groupBy(extension.alias("extension")).agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes")).orderBy(F.desc("n_files"), "extension")
