"""One form for text that looks the same.

Canonical equivalents (Hangul among them), full and half width forms, ligatures, spaces of any width and
look-alike letters, numerals and hyphens are brought to one character each; invisible characters go.
Case, accents, digits, raised digits and all other characters stay.
"""

from __future__ import annotations

import itertools
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.functions.text import pick
from citeloom.llm.pairs import class_pairs, hot_keys
from citeloom.operators.skew import heavy_keys, lookup, spread_join
from citeloom.session import materialize

# Characters and the character each looks like. All are confusable by the public table of
# confusable characters (Unicode technical standard 39, tested); taken are only those of another script
# and the same case whose shape is the same, not merely similar.
CYRILLIC = ("АВЕЅІӀЈКМНОРСТУҮХѴԌԜ" "аеѕіӏјорсуүхһѵԁԛԝ" "ГПФѰӘәԐӔӕ", "ABESIIJKMHOPCTYYXVGW" "aesiljopcyyxhvdqw" "ΓΠΦΨƏəƐÆæ")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϹϜ" "ονϲϳµ", "ABEZHIKMNOPTYXJCF" "ovcjμ")
ARMENIAN = ("ՕՍօ", "OUo")
CHEROKEE = ("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ")
COPTIC = ("ⲤⲎⲔⲘⲚⲞⲢⲦⲬⲟⲥ", "CHKMNOPTXoc")
LISU = ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU")
HYPHENS = ("‐‑", "--")
QUOTES = ("ʼʻ", "’‘")
ALIKE = (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, LISU, HYPHENS, QUOTES)
# Invisible beside the format characters (category Cf) and the variation selectors: joiners and fillers of other categories.
INVISIBLE = "͏ᅟᅠ឴឵ㅤﾠ"
VARIATION = ((0x180B, 0x180D), (0x180F, 0x180F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF))
# Hangul: first and last of the leading consonants, vowels, trailing consonants and syllables.
LEAD, VOWEL, TRAIL, SYLLABLE = (0x1100, 0x1112), (0x1161, 0x1175), (0x11A8, 0x11C2), (0xAC00, 0xD7A3)


@cache
def mapping() -> dict[int, str]:
    """Code point to its characters in the one form, where they differ from it. Made from the Unicode database by rule."""
    alike = {ord(a): b for seen, one in ALIKE for a, b in zip(seen, one, strict=True)}
    out: dict[int, str] = {}
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind in ("Cs", "Cn", "Co"):
            continue
        if kind == "Cf" or c in INVISIBLE or any(a <= i <= b for a, b in VARIATION):
            out[i] = ""
            continue
        if kind == "Zs":
            if c != " ":
                out[i] = " "
            continue
        if SYLLABLE[0] <= i <= SYLLABLE[1]:
            continue
        rule = unicodedata.decomposition(c)
        if rule.startswith(("<wide>", "<narrow>")):
            to = unicodedata.normalize("NFD", chr(int(rule.split()[1], 16)))
        elif 0xFB00 <= i <= 0xFB06 or 0x2160 <= i <= 0x217F:  # ligatures, Roman numerals
            to = unicodedata.normalize("NFKC", c)
        else:
            to = unicodedata.normalize("NFD", c)
        to = unicodedata.normalize("NFC", "".join(alike.get(ord(x), x) for x in to))
        if to != c:
            out[i] = to
    return out


def decomposed(text: str) -> str:
    """Canonical decomposition, with the letters mapped again (a look-alike may carry an accent)."""
    table = mapping()
    full = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFD", "".join(table.get(ord(c), c) for c in full))


@cache
def _rows() -> tuple[list[tuple[int, str, str]], list[tuple[int, int]], list[tuple[str, str, str]]]:
    """Mapping (code point, one form, its decomposition), classes (mark, class), compositions (first, mark, whole)."""
    table = mapping()
    forms, classes, whole = [], [], []
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if 0xD800 <= i <= 0xDFFF or SYLLABLE[0] <= i <= SYLLABLE[1]:  # surrogates; syllables take their trailing consonant as they are
            continue
        one = table.get(i, c)
        parts = decomposed(one)
        if one != c or parts != c:
            forms.append((i, one, parts))
        if k := unicodedata.combining(c):
            classes.append((i, k))
        pair = unicodedata.decomposition(c)
        if pair and not pair.startswith("<") and len(pair.split()) == 2 and unicodedata.normalize("NFC", c) == c:
            a, b = (chr(int(x, 16)) for x in pair.split())
            whole.append((a, b, c))
    return forms, classes, whole


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mapping tables; their size is that of the Unicode database (a few thousand rows), not of the data."""
    forms, classes, whole = _rows()
    return (
        F.broadcast(spark.createDataFrame(forms, "cp int, one string, parts string")),
        F.broadcast(spark.createDataFrame(classes, "mark int, class int")),
        F.broadcast(spark.createDataFrame(whole, "first string, mark string, whole string")),
    )


def _ranges(points: list[int]) -> str:
    """Content of a character class; runs of the list become ranges in its order."""
    out, start = [], None
    for i, p in enumerate(points):
        start = p if start is None else start
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(rf"\x{{{start:X}}}-\x{{{p:X}}}")
            start = None
    return "".join(out)


#: Where stable stretches begin; a character class of few ranges is fast. Any other character that never changes is a piece of its own.
STRETCHES = (0x0, 0x4E00, 0xB6, 0x426, 0x436, 0x446, 0x2012, 0x2030, 0x3001)


@cache
def _classes() -> tuple[str, str, str]:
    """Contents of character classes: stable characters (they never change and nothing joins them to a character before), invisible ones, and marks, that is all that may join a character before it."""
    table = mapping()

    def changes(i: int) -> bool:
        jamo = 0x1100 <= i <= 0x11FF or 0xA960 <= i <= 0xA97F or 0xD7B0 <= i <= 0xD7FF
        return i in table or jamo or 0xD800 <= i <= 0xDFFF or unicodedata.category(chr(i)).startswith("M")

    stable = [i for start in STRETCHES for i in itertools.takewhile(lambda i: not changes(i), range(start, 0x10000))]
    invisible = _ranges(sorted(i for i, to in table.items() if to == ""))
    marks = rf"\p{{M}}ﾞﾟ{chr(VOWEL[0])}-{chr(VOWEL[1])}{chr(TRAIL[0])}-{chr(TRAIL[1])}"
    return _ranges(stable), invisible, marks


def _patterns() -> tuple[str, str, str]:
    """Regular expressions: a character that isn't stable; the pieces of a text; the pieces with marks.

    Plain characters are told by a class of ASCII first, and only others are looked at again.
    Pieces are a run of stable characters (without the last one if marks follow it), a base with its
    marks (invisible characters may stand between), stray marks, or one other character.
    """
    stable, invisible, marks = _classes()
    tail = f"[{invisible}]*+[{marks}]"
    cluster = f"[^{marks}{invisible}](?:{tail})++"
    stray = f"(?![{invisible}])[{marks}]"
    run = f"[{stable}]++(?!{tail})|[{stable}]+(?=[{stable}])"
    return rf"[^\x00-\x7F](?<![{stable}])", f"(?s){run}|{cluster}|{stray}(?:{tail})*+|.", f"(?s){cluster}|{stray}(?:{tail})++"


#: Distinct bases with marks up to which their table is broadcast, and texts that look like others up to which theirs is.
MOST_CLUSTERS, MOST_ALIKE = 100_000, 500_000


def _within(c: Column, span: tuple[int, int]) -> Column:
    return c.between(*span)


def _composed(clusters: DataFrame, forms: DataFrame, classes: DataFrame, whole: list[tuple[str, str, str]]) -> DataFrame:
    """(piece, composed) of distinct pieces with marks: taken apart, marks ordered by class, recomposed; Hangul by its arithmetic rule."""
    points = clusters.select("piece", F.posexplode(F.split("piece", "")).alias("at", "c")).where("c <> ''")
    points = points.withColumn("cp", F.ascii("c")).join(forms, "cp", "left")
    points = points.select("piece", "at", F.posexplode(F.split(F.coalesce("parts", "c"), "")).alias("sub", "c")).where("c <> ''")
    points = points.withColumn("mark", F.ascii("c")).join(classes, "mark", "left")
    order = Window.partitionBy("piece").orderBy("at", "sub")
    before = F.ascii(F.lag("c").over(order))
    joins = (_within(F.col("mark"), VOWEL) & _within(before, LEAD)) | (_within(F.col("mark"), TRAIL) & (_within(before, VOWEL) | _within(before, SYLLABLE)))
    points = points.withColumn("starts", F.col("class").isNull() & ~F.coalesce(joins, F.lit(False)))
    base = F.sum(F.when(F.col("starts"), 1).otherwise(0)).over(order)
    points = points.select("piece", base.alias("base"), F.coalesce("class", F.lit(0)).alias("class"), "at", "sub", "c")
    ordered = points.groupBy("piece", "base").agg(F.array_sort(F.collect_list(F.struct("class", "at", "sub", "c"))).alias("cs"))

    # A mark joins its base if the two have a composition and no mark of its class or a higher one is left between.
    table = F.map_from_arrays(F.array(*(F.lit(a + b) for a, b, _ in whole)), F.array(*(F.lit(c) for *_, c in whole)))
    start = F.struct(F.lit("").alias("base"), F.lit("").alias("left"), F.lit(-1).alias("last"))

    def syllable(a: Column, b: Column) -> Column:
        a, b = F.ascii(a), F.ascii(b)
        open_ = F.when(_within(a, LEAD) & _within(b, VOWEL), SYLLABLE[0] + ((a - LEAD[0]) * 21 + (b - VOWEL[0])) * 28)
        closed = F.when(_within(a, SYLLABLE) & ((a - SYLLABLE[0]) % 28 == 0) & _within(b, TRAIL), a + b - (TRAIL[0] - 1))
        return F.decode(F.unhex(F.hex(F.coalesce(open_, closed))), "UTF-16BE")

    def step(acc, x):
        joined = F.coalesce(table[F.concat(acc["base"], x["c"])], F.when((acc["base"] != "") & (acc["left"] == ""), syllable(acc["base"], x["c"])))
        first = (acc["base"] == "") & (acc["left"] == "")
        fits = joined.isNotNull() & (x["class"] > acc["last"]) & (acc["base"] != "")
        base = F.when(first, x["c"]).when(fits, joined).otherwise(acc["base"])
        left = F.when(first | fits, acc["left"]).otherwise(F.concat(acc["left"], x["c"]))
        last = F.when(first | fits, acc["last"]).otherwise(x["class"])
        return F.struct(base.alias("base"), left.alias("left"), last.alias("last"))

    done = ordered.select("piece", "base", F.aggregate("cs", start, step, lambda acc: F.concat(acc["base"], acc["left"])).alias("done"))
    whole_piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "done"))), lambda x: x["done"]), "")
    return done.groupBy("piece").agg(whole_piece.alias("composed"))


def _hashed(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text, h, special): special texts hold a character that isn't stable; all others are in the one form already."""
    rows = pick(df, {"id": id_column, "text": text_column})
    return rows.select("id", "text", F.unhex(F.sha2("text", 256)).alias("h"), F.coalesce(F.col("text").rlike(_patterns()[0]), F.lit(False)).alias("special"))


def _special_forms(rows: DataFrame) -> DataFrame:
    """(h, form) of the distinct special texts.

    Equal texts are combined before the one shuffle of texts, by their hash; explosion and rebuilding
    keep that partitioning, so no task gets more than the pieces of one text at a time.
    """
    forms, classes, _ = _tables(rows.sparkSession)
    _, pieces_of, clusters_of = _patterns()
    special = rows.where("special")
    texts = special.groupBy("h").agg(F.first("text").alias("text"))
    pieces = texts.select("h", F.posexplode_outer(F.regexp_extract_all("text", F.lit(pieces_of), F.lit(0))).alias("pos", "piece"))
    single = F.char_length("piece") == 1
    pieces = pieces.withColumn("cp", F.when(single, F.ascii("piece"))).join(forms.drop("parts"), "cp", "left")
    marks = _classes()[2]
    marked = ~single & F.substring("piece", -1, 1).rlike(f"[{marks}]")  # a piece with marks ends in one
    pieces = pieces.select("h", "pos", F.coalesce("one", "piece").alias("out"), F.when(marked, F.col("piece")).alias("cluster"))

    found = F.array_distinct(F.regexp_extract_all("text", F.lit(clusters_of), F.lit(0)))
    clusters = special.where(F.col("text").rlike(f"[{marks}]")).select(F.explode_outer(found).alias("piece")).where("piece is not null").distinct()  # explode alone would evaluate its array twice
    composed = materialize(_composed(clusters, forms.drop("one"), classes, _rows()[2])).select(F.col("piece").alias("cluster"), "composed")
    if composed.count() <= MOST_CLUSTERS:
        built = pieces.join(F.broadcast(composed), "cluster", "left")
    else:
        built = lookup(pieces, composed, "cluster")
    built = built.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("composed", "out").alias("out")))).alias("all"))
    return built.select("h", F.array_join(F.transform("all", lambda x: x["out"]), "").alias("form"))


def one_form(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, form): every row's text in the one form; null stays null, empty stays empty.

    Texts of stable characters only are in it already. All others are exploded to positioned code
    points, where a stretch of stable characters stays one piece and a base stays with its marks. Code
    points meet the mapping of decompositions, look-alikes and invisible characters in a broadcast join.
    Bases with marks, each distinct one once, are taken apart, their marks ordered by class, and
    recomposed. The text is put together again by position.

    Equal texts are treated once, under their hash, so repeated rows, equal ids and null ids do no
    harm; the rows of a text that stands very often are spread when they get its form back. The mapping
    tables have the size of the Unicode database, whatever the data.
    """
    rows = _hashed(df, id_column, text_column)
    plain = rows.where("not special").select("id", F.col("text").alias("form"))
    fancy = rows.where("special").select("id", "h")
    fancy = spread_join(fancy, _special_forms(rows), "h", heavy_keys(fancy, "h")).select("id", "form")
    return plain.unionByName(fancy).select(F.col("id").alias(id_column), "form")


def alike_pairs(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: every two rows whose texts differ but have the same form.

    Texts with nothing visible and null texts are no case. Distinct texts are compared first, by the
    hashes of their forms; only rows of texts that look like another meet in pairs.
    """
    rows = _hashed(df, id_column, text_column)
    visible = r"[^\s\p{Z}]"
    forms = materialize(_special_forms(rows).where(F.col("form").rlike(visible)).select("h", F.unhex(F.sha2("form", 256)).alias("key")))
    plain = rows.where(~F.col("special") & F.col("text").rlike(visible)).select("h", F.col("h").alias("key"))
    texts = forms.unionByName(plain)
    several = materialize(texts.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key"))
    alike = materialize(lookup(texts, several, "key", "inner", heavy=heavy_keys(forms, "key")).distinct())
    held = rows.select("id", "h").where("id is not null and h is not null")
    members = held.join(F.broadcast(alike), "h") if alike.count() <= MOST_ALIKE else lookup(held, alike, "h", "inner")
    members = materialize(members.select("id", "key", F.col("h").alias("text_hash")))
    return class_pairs(members, hot_keys(members), f"{id_column}_a", f"{id_column}_b", differ="text_hash")
