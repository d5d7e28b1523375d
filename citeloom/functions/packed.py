"""Several values packed in one text field, split into an array."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import SPACE, strip

MARK, ESCAPE = "\x01", "\x02"


@dataclass(frozen=True)
class Layout:
    """`separators` always part values; `soft` ones only next to a quoted value."""

    separators: str
    soft: str = ""

    @property
    def every(self) -> str:
        return "".join("\\" + x if x in r"|[]\^-&" else x for x in self.separators + self.soft)

    @property
    def hard(self) -> str:
        return "".join("\\" + x if x in r"|[]\^-&" else x for x in self.separators)


KEYWORDS = Layout(";,|、\n")
CATEGORIES = Layout(";|/\n", soft=",")
REFERENCES = Layout(";,|\n")

# A quoted span; possessive, so that neither depth nor time grows with its length.
SPAN = r"""(?:"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"|'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+')"""


def _count(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def _unescape(body: Column) -> Column:
    """Escaped characters stand for themselves, `\\t \\n \\r` for the control characters that list texts write so."""
    for letter, control in (("t", "\t"), ("n", "\n"), ("r", "\r")):
        body = F.regexp_replace(body, rf"(?<!\\)((?:\\\\)*+)\\{letter}", f"$1{control}")
    return F.regexp_replace(body, r"(?s)\\(.)", "$1")


def split_packed(df: DataFrame, column: str, out: str, layout: Layout) -> DataFrame:
    """Add array column `out`: the values packed in `column`, as typed, in order.

    Method: quoted spans are replaced by indexed placeholders, the rest is split at the separators,
    and the spans are put back by array lookup. The placeholder's mark can't collide with the text:
    where the text holds the mark it is escaped first.

    A span is quoted only where a quote opens a value and closes it. Enclosing quotes, list brackets
    and white space aren't part of a value; inside quotes doubled and escaped characters stand for
    themselves; empty places are no values. A list bracket counts only at the outer ends; a closing
    one that belongs to an inner bracket stays. Null, empty and `[]` give an empty array.

    Everything is a built-in expression in one projection: no shuffle and no Python. The steps are
    separate columns, because an expression used twice would be evaluated twice. For the same reason
    unpack `out` with `explode_outer` and drop the nulls: `explode` makes the optimizer push a filter
    on the array below all the steps, with each step written out wherever the next one uses it.
    """
    t, p, u, m, b = (f"__{out}_{x}" for x in ("text", "pieces", "spans", "masked", "body"))
    c = lambda name: F.col(f"`{name}`")
    df = df.withColumn(t, strip(F.coalesce(c(column).cast("string"), F.lit(""))))
    clean = ~c(t).contains(MARK) & ~c(t).contains(ESCAPE)
    escaped = F.replace(F.replace(c(t), F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(MARK), F.lit(ESCAPE + "a"))
    df = df.withColumn(t, F.when(clean, c(t)).otherwise(escaped))

    gap = rf"[\s\p{{Z}}\x1c-\x1f\x85&&[^{layout.every}]]"
    quoted = rf"(?s)(^|[{layout.every}]|^\[){SPACE}*+({SPAN})(?={gap}*+(?:[{layout.every}\]]|\z))"
    marked = F.regexp_replace(c(t), quoted, f"$1{MARK}$2{MARK}")
    has_quote = c(t).contains('"') | c(t).contains("'")
    df = df.withColumn(p, F.when(has_quote, F.split(marked, MARK, -1)).otherwise(F.array(c(t))))

    # Odd pieces are spans. Doubled and escaped characters are rare, so only rows that hold one pay.
    bare = F.transform(c(p), lambda x: x.substr(F.lit(2), F.length(x) - 2))
    special = c(t).contains('""') | c(t).contains("''") | c(t).contains("\\")
    single = F.transform(c(p), lambda x: F.when(x.startswith('"'), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit("''"), F.lit("'"))))
    df = df.withColumn(u, F.when(F.size(c(p)) < 2, F.array().cast("array<string>")).when(special, F.transform(single, _unescape)).otherwise(bare))
    numbered = F.array_join(
        F.transform(c(p), lambda x, i: F.when(i % 2 == 1, F.concat(F.lit(MARK), i.cast("string"), F.lit(MARK))).otherwise(x)), ""
    )
    df = df.withColumn(m, F.when(F.size(c(p)) > 1, numbered).otherwise(c(t)))

    inner = F.substring(c(m), 2, 1 << 30)
    unopened = c(m).endswith("]") & (_count(inner, "]") > _count(inner, "["))
    body = F.when(~c(m).startswith("["), c(m)).when(unopened, F.substr(c(m), F.lit(2), F.length(c(m)) - 2)).otherwise(inner)
    if layout.soft:
        soft, hard = "".join("\\" + x for x in layout.soft), layout.separators[0]
        beside = F.regexp_replace(body, rf"({MARK}\d+{MARK}{SPACE}*+)[{soft}]", f"$1{hard}")
        beside = F.regexp_replace(beside, rf"[{soft}](?={SPACE}*+{MARK})", hard)
        body = F.when(F.size(c(p)) > 1, beside).otherwise(body)
    # Outside the spans all separators are alike; one plain character splits without a pattern.
    one = layout.separators[0]
    for other in layout.separators[1:]:
        body = F.replace(body, F.lit(other), F.lit(one))
    df = df.withColumn(b, body)

    def restore(part: Column) -> Column:
        at = part.substr(F.lit(2), F.length(part) - 2).try_cast("int")
        return strip(F.when(part.startswith(MARK), F.get(c(u), at)).otherwise(part))

    plain = F.transform(F.split(c(b), one, -1), strip)
    plain = F.when(F.size(c(p)) > 1, F.transform(plain, restore)).otherwise(plain)
    back = F.transform(plain, lambda x: F.replace(F.replace(x, F.lit(ESCAPE + "a"), F.lit(MARK)), F.lit(ESCAPE + "b"), F.lit(ESCAPE)))
    whole = F.when(c(t).contains(ESCAPE), back).otherwise(plain)
    return df.withColumn(out, F.filter(whole, lambda x: F.length(x) > 0)).drop(t, p, u, m, b)
