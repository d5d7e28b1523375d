"""Columns by alias, and the cleaning run (OP-12 to OP-18, OP-66)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.parsing import dois_of_text, is_conference
from citeloom.operators.ranking import from_year, of_periodicals, top_periodicals


def find_column(names: Sequence[str], aliases: Sequence[str]) -> str | None:
    """OP-13: the first alias with an equal name, else the first that is equal without case and outer white space."""
    for alias in aliases:
        if alias in names:
            return alias
    loose = {}
    for name in names:
        loose.setdefault(str(name).lower().strip(), name)
    return next((loose[a.lower().strip()] for a in aliases if a.lower().strip() in loose), None)


def map_columns(df: DataFrame, aliases: Mapping[str, Sequence[str]], needed: Sequence[str] | None = None) -> DataFrame:
    """OP-14: columns renamed to their targets, those needed kept, in the order of `aliases`, then of `df`; targets without a column are missing."""
    found = {t: c for t, a in aliases.items() if (c := find_column(df.columns, a)) is not None}
    wanted = set(needed) if needed is not None else {*aliases, *df.columns}
    taken = set(found.values())
    columns = [F.col(f"`{c}`").alias(t) for t, c in found.items() if t in wanted]
    columns += [F.col(f"`{c}`") for c in df.columns if c in wanted and c not in taken and c not in found]
    return df.select(*columns)


@dataclass(frozen=True)
class Cleaning:
    """OP-12: what a cleaning run keeps."""

    drop_conference: bool = True
    min_year: int | None = None
    target_periodicals: Sequence[str] = field(default_factory=tuple)
    top_n: int = 10

    @classmethod
    def from_config(cls, config: Mapping) -> "Cleaning":
        """From a configuration with the sections data_source, cleaning and field_mapping, all mandatory."""
        missing = [k for k in ("data_source", "cleaning", "field_mapping") if k not in config]
        if missing:
            raise ValueError(f"missing sections: {missing}")
        c = config["cleaning"] or {}
        return cls(bool(c.get("drop_conference", True)), c.get("min_year") or None, tuple(c.get("target_periodicals") or ()), int(c.get("top_n") or 10))


def with_references(df: DataFrame, text: str, out: str = "refs") -> DataFrame:
    """Add the DOIs of a free reference text."""
    return df.withColumn(out, dois_of_text(F.col(text)))


def clean(papers: DataFrame, cleaning: Cleaning, title: str = "title") -> tuple[DataFrame, DataFrame]:
    """(background, target): rows (periodical, year, title, ...) without conference papers and early years; of the listed periodicals, or else of the largest."""
    kept = papers.where(~is_conference(F.col(title))) if cleaning.drop_conference else papers
    kept = from_year(kept, cleaning.min_year)
    if cleaning.target_periodicals:
        return kept, kept.where(F.col("periodical").isin(*cleaning.target_periodicals))
    return kept, of_periodicals(kept, top_periodicals(kept, cleaning.top_n))
