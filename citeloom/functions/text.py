"""Column expressions on text that several operators share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space as Python's `str.strip` understands it, in Java regular expressions.
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def pick(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """`df` reduced to `{new name: old name}`.

    An exactly equal name wins over one that differs in case; of equal names the first is taken.
    Other columns may have any names, also those an operator uses inside. A missing name raises.
    """
    names = df.columns
    places = {}
    for new, old in columns.items():
        found = [i for i, n in enumerate(names) if n == old] or [i for i, n in enumerate(names) if n.lower() == old.lower()]
        if not found:
            raise ValueError(f"no column {old!r} among {names}")
        places[new] = found[0]
    if len({n.lower() for n in names}) == len(names):
        return df.select(*(F.col(f"`{names[i].replace('`', '``')}`").alias(new) for new, i in places.items()))
    renamed = df.toDF(*(f"c{i}" for i in range(len(names))))
    return renamed.select(*(F.col(f"c{i}").alias(new) for new, i in places.items()))


#: The same as single characters.
SPACES = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without outer white space; looks at the ends only."""
    return F.btrim(c, F.lit(SPACES))


def plain_form(c: Column) -> Column:
    """Lower-case, outer white space removed, inner runs of white space one space; null stays null."""
    return F.lower(F.trim(F.regexp_replace(c, rf"{SPACE}++", " ")))


def doi_key_or_empty(c: Column) -> Column:
    """As `doi_key`, but the empty text where there is no DOI."""
    gap = r"[^A-Za-z0-9/.\-]{0,3}"
    tail = F.regexp_extract(c, rf"(?s)(?<![0-9])1{gap}0{gap}[.·．]{gap}[0-9].*", 0)
    # Nearly all start with it; they need no search.
    return F.lower(F.regexp_replace(F.when(c.startswith("10."), c).otherwise(tail), "[^A-Za-z0-9]++", ""))


def doi_key(c: Column) -> Column:
    """Letters a-z and digits from the leading `10.` on, lower-case; null where there is no DOI.

    The `10.` counts as leading where no digit stands before it and a digit follows it, so a year
    that ends a sentence (`in 2010. Then`) is no DOI. Dots and digits may be set apart by spaces or
    invisible characters.
    """
    return F.nullif(doi_key_or_empty(c), F.lit(""))
