import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.functions.packed import CATEGORIES, KEYWORDS, REFERENCES, split_packed
from citeloom.functions.text import doi_key, pick, plain_form
from citeloom.operators.packed_fields import unpack_fields

CASES = [
    (KEYWORDS, None, []),
    (KEYWORDS, "", []),
    (KEYWORDS, "   ", []),
    (KEYWORDS, "[]", []),
    (KEYWORDS, "a; b ;; c;", ["a", "b", "c"]),
    (KEYWORDS, "a, b|c、d\ne", ["a", "b", "c", "d", "e"]),
    (KEYWORDS, "['a', \"b's\", 'c;d']", ["a", "b's", "c;d"]),
    (KEYWORDS, "['a', 'b'", ["a", "b"]),
    (KEYWORDS, "['a' , 'b',]", ["a", "b"]),
    (KEYWORDS, "[a, b [1], c [1]]", ["a", "b [1]", "c [1]"]),
    (KEYWORDS, "[a, b [1]", ["a", "b [1]"]),
    (KEYWORDS, '"lens, a"; b; "the ""slow"" mode"', ["lens, a", "b", 'the "slow" mode']),
    (KEYWORDS, '["4\\" hole", "x\\\\y"]', ['4" hole', "x\\y"]),
    (KEYWORDS, "sailor's almanac; weaver's knot", ["sailor's almanac", "weaver's knot"]),
    (KEYWORDS, '4" hole; b', ['4" hole', "b"]),
    (KEYWORDS, '"a"\n"b; c"\nd', ["a", "b; c", "d"]),
    (KEYWORDS, "a; \x01 b\x02; \"c;\x01d\"", ["a", "\x01 b\x02", "c;\x01d"]),
    (KEYWORDS, "a; a; a", ["a", "a", "a"]),
    (CATEGORIES, "Optics, Guided; Soil | Reef/", ["Optics, Guided", "Soil", "Reef"]),
    (CATEGORIES, "['Optics, Guided', 'Soil']", ["Optics, Guided", "Soil"]),
    (CATEGORIES, '"Optics, Guided", "Soil"', ["Optics, Guided", "Soil"]),
    (REFERENCES, "['\\t10.1/a', '10.1/b;2-x\\t']", ["10.1/a", "10.1/b;2-x"]),
    (REFERENCES, '"10.1/a;2-b", 10.1/c | in press', ["10.1/a;2-b", "10.1/c", "in press"]),
]


@pytest.mark.parametrize("layout", [KEYWORDS, CATEGORIES, REFERENCES])
def test_layouts(spark, layout):
    cases = [(i, t, want) for i, (l, t, want) in enumerate(CASES) if l is layout]
    df = spark.createDataFrame([(i, t) for i, t, _ in cases], "i int, t string")
    got = {r.i: r.v for r in split_packed(df, "t", "v", layout).collect()}
    assert got == {i: want for i, _, want in cases}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.text("ab '\";,|\n[]\x01é", max_size=8), max_size=4), min_size=1, max_size=40))
def test_json_lists_come_back(spark, rows):
    rows = [[v.strip() for v in r if v.strip() and "\\t" not in v] for r in rows]
    # JSON writes a line end as an escape that is read back as one.
    df = spark.createDataFrame([(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(rows)], "i int, t string")
    got = {r.i: r.v for r in split_packed(df, "t", "v", KEYWORDS).collect()}
    want = {i: r for i, r in enumerate(rows)}
    for i in want:
        if "\\u" not in json.dumps(rows[i], ensure_ascii=False):
            assert got[i] == want[i]


def test_long_text_and_many_quotes(spark):
    text = "; ".join(f'"value {i}; x"' for i in range(20_000))
    df = spark.createDataFrame([(text,), ("x" * 1_000_000,), ('"' * 50_001,)], "t string")
    sizes = [len(r.v) for r in split_packed(df, "t", "v", KEYWORDS).select("v").collect()]
    assert sizes[:2] == [20_000, 1] and sizes[2] >= 1


def test_unpack_with_odd_columns(spark):
    df = spark.createDataFrame([(1, "a;b", None, "10.1/x", "junk"), (None, "c", "K", "", "junk"), (1, "a;b", None, "10.1/x", "junk")], "record_id long, Keywords string, `WoS Categories` string, citing string, pos string")
    rows = unpack_fields(df).collect()
    assert rows[0].__fields__ == ["record_id", "field_name", "pos", "value"]
    assert sorted((r.record_id or 0, r.field_name, r.pos, r.value) for r in rows) == sorted(2 * [(1, "Keywords", 1, "a"), (1, "Keywords", 2, "b"), (1, "citing", 1, "10.1/x")] + [(0, "Keywords", 1, "c"), (0, "WoS Categories", 1, "K")])
    assert unpack_fields(df.limit(0)).count() == 0


def test_pick_takes_the_exact_name(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("DOI", "doi", "x.y")
    assert pick(df, {"k": "doi", "z": "x.y"}).collect() == [(2, 3)]
    with pytest.raises(ValueError):
        pick(df, {"k": "none"})


def test_keys_and_plain_forms(spark):
    typed = {
        "https://doi.example/10.90001/S10-37(96)x-3.": "1090001s103796x3", "doi: 10.90002 /a–B": "1090002ab", "１": None, "in 2010. Then": None, "nan": None, "": None, None: None,
        "​10.9/\xad x": "109x", "1​0.90001/q": "1090001q", "DOI 10.5/10.6": "105106",
    }
    df = spark.createDataFrame([(t,) for t in typed], "t string")
    got = {r.t: r.k for r in df.select("t", doi_key(df.t).alias("k")).collect()}
    assert got == typed
    plain = spark.createDataFrame([("  A\t b  c ",), (None,)], "t string")
    assert [r[0] for r in plain.select(plain_form(plain.t)).collect()] == ["a b c", None]
