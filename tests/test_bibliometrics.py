"""Hand-computed cases of the bibliometric operators."""

import difflib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from citeloom.functions import parsing as P
from citeloom.operators import citation, diversity, entropy, ingest, novelty, ranking, themes


def graph(spark, refs, rows=None):
    rows = rows or [(k, list(v), n) for n, (k, v) in enumerate(refs.items())]
    return spark.createDataFrame(rows, "id string, refs array<string>, row_no int")


def test_disruption_by_hand(spark):
    df = graph(spark, {"A": "BC", "B": "C", "C": "", "D": "A", "E": "AB", "F": "B"})
    got = {r.id: (r.ni, r.nj, r.nk, r.d) for r in citation.d_index(df, df).collect()}
    assert got == {"A": (1, 1, 3, 0.0), "B": (2, 1, 1, 0.25), "C": (2, 0, 0, 1.0), "D": (0, 0, 2, 0.0), "E": (0, 0, 4, 0.0), "F": (0, 0, 3, 0.0)}


@pytest.mark.parametrize("seed", range(4))
def test_disruption_with_papers_in_several_rows(spark, seed):
    rng = random.Random(seed)
    names = [f"p{i}" for i in range(14)] + [None]
    rows = [(rng.choice(names), rng.sample(names[:-1], rng.randint(0, 4)), n) for n in range(40)]
    refs, citers = {}, defaultdict(set)
    for p, rs, _ in rows:
        if p is not None:
            refs[p] = set(rs)
            for r in rs:
                citers[r].add(p)

    def brute(f):
        mine, c = refs.get(f, set()), citers[f]
        nj = sum(bool(refs[x] & mine) for x in c)
        nk = len(set().union(*(citers[r] for r in mine)) - c)
        ni = len(c) - nj
        return ni, nj, nk, (ni - nj) / (ni + nj + nk) if ni + nj + nk else 0.0

    target = spark.createDataFrame([(p,) for p in [*names, "unknown"]], "id string")
    got = {r.id: (r.ni, r.nj, r.nk, r.d) for r in citation.d_index(graph(spark, None, rows), target).collect()}
    assert got == {f: brute(f) for f in [*names[:-1], "unknown"]}


def test_null_keys(spark):
    target = spark.createDataFrame([("a", "x"), (None, "x"), (None, "y"), (None, None)], "id string, periodical string")
    scores = spark.createDataFrame([("a", 0.5)], "id string, d double")
    rows = citation.score_rows(target, scores, "match")
    assert rows.count() == 10
    assert {r.periodical: (r.disruption_mean, r.paper_count) for r in citation.periodical_mean(rows).collect()} == {"x": (0.125, 1), "y": (0.0, 0)}
    assert citation.score_rows(target, scores).count() == 1
    with pytest.raises(ValueError):
        citation.score_rows(target, scores, "other")


def test_enhanced(spark):
    rows = spark.createDataFrame([("j", str(i), float(i)) for i in range(12)] + [("one", "z", 1.0), (None, "n", 1.0), ("k", None, None)], "periodical string, id string, d double")
    got = {r.periodical: (r.n_papers, r.top_k_mean, r.enhanced_disruption) for r in citation.periodical_enhanced(rows).collect()}
    assert got["j"][:2] == (12, 6.5) and math.isclose(got["j"][2], 6.5 * (0.6 + 0.4 / math.log(13)))
    assert math.isclose(got["one"][2], 1.1770780164, rel_tol=1e-9) and set(got) == {"j", "one"}


@pytest.mark.parametrize("absolute", [False, True])
def test_novelty_by_hand(spark, absolute):
    rows = spark.createDataFrame([(0, 2018, ["a1", "b1", "c1"]), (1, 2020, ["a1", "b1"]), (2, 2021, ["b1", "c1", "d1"])], "row int, year int, keywords array<string>")
    first = novelty.timeline(rows)
    got = {r.row: r.novelty for r in novelty.paper_novelty(rows.where("row > 0"), first, 2021, absolute=absolute).collect()}
    assert got[1] == 0.0 and math.isclose(got[2], 2 / 3)
    drill = {(r.k1, r.k2): r.novel for r in novelty.drill_down(rows, first, 2, 2021).collect()}
    assert drill == {("b1", "c1"): False, ("b1", "d1"): True, ("c1", "d1"): True}


def test_repeated_keywords_pair_with_themselves(spark):
    df = spark.createDataFrame([(["x", "x", "a"],), (["x"],), ([],)], "keywords array<string>")
    got = [[tuple(p) for p in r[0]] for r in df.select(novelty.pairs_of(F.col("keywords"))).collect()]
    assert got == [[("x", "x"), ("a", "x"), ("a", "x")], [], []]


def test_diversity_by_reference_categories(spark):
    papers = spark.createDataFrame([("X", ["p", "q"]), ("Y", ["q", "r"]), ("Z", ["p"])], "id string, categories array<string>")
    similarity = diversity.salton(diversity.category_counts(papers, distinct=False, least=2))
    s = {(r.i, r.j): round(r.s, 6) for r in similarity.collect()}
    assert (s["p", "q"], s["q", "r"], s["p", "r"], s["q", "q"]) == (0.866025, 0.866025, 0.5, 1.0)
    target = spark.createDataFrame([(1, ["X", "Y", "Z"]), (2, ["Z"])], "row int, refs array<string>")
    z = diversity.shared(diversity.reference_categories(target, papers), similarity)
    td = {r.row: r.td for r in z.select("row", diversity.td_from_diversity(F.col("z"), F.col("n_categories")).alias("td")).collect()}
    assert math.isclose(td[1], 6.9296320584, rel_tol=1e-9) and td[2] == 1.0


def test_similarity_of_whole_categories(spark):
    names = spark.createDataFrame([("X", ["p"]), ("Y", ["q"]), ("Z", ["r"]), ("W", ["q"])], "id string, categories array<string>")
    rows = spark.createDataFrame([(1, ["X", "Y"]), (2, ["Y", "Z", "W"]), (3, ["X"]), (4, [])], "row int, refs array<string>")
    found = diversity.reference_categories(rows, names)
    counts = diversity.category_counts(found.groupBy("row").agg(F.collect_list("category").alias("categories")), distinct=True, least=1)
    assert {(r.i, r.j): r.n for r in counts.collect()} == {("p", "p"): 2, ("q", "q"): 2, ("r", "r"): 1, ("p", "q"): 1, ("q", "p"): 1, ("q", "r"): 1, ("r", "q"): 1}
    z = diversity.shared(found, diversity.salton(counts))
    td = {r.row: round(r.td, 6) for r in rows.join(z, "row", "left").select("row", diversity.td_from_similarity(F.col("z")).alias("td")).collect()}
    assert td == {1: 1.155871, 2: 1.063314, 3: 1.0, 4: 1.0}


def test_entropy(spark):
    shares = spark.createDataFrame([(1, "a", 2, 2 / 3), (1, "b", 1, 1 / 3), (2, "a", 5, 1.0), *((3, f, 1, 0.25) for f in "abcd")], "row int, field string, n int, share double")
    got = {r.row: round(r.entropy, 6) for r in entropy.entropy(shares).collect()}
    assert got == {1: 0.918296, 2: 0.0, 3: 2.0}


def test_similar_keywords(spark):
    words = spark.createDataFrame([(w,) for w in ("neural nets", "deep lerning", "brains", "graph", "Tide", " Brain ")], "keyword string")
    terms = spark.createDataFrame([("cs", "neural networks"), ("cs", "deep learning"), ("bio", "brain"), ("cs", "tree"), ("bio", "diet"), ("x", "brain")], "field string, term string")
    got = {(r.keyword, r.field) for r in entropy.match_fields(words, terms).collect()}
    assert got == {("neural nets", "cs"), ("deep lerning", "cs"), ("brains", "bio"), ("brains", "x"), (" Brain ", "bio"), (" Brain ", "x")}
    assert entropy.match_fields(words, terms.limit(0)).count() == 0


def values(spark, parse, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse(F.col("t"))).collect()]


def test_dois(spark):
    got = values(spark, P.dois_of_text, "J, DOI [10.1000/xyz12345, 10.1000/q.99999]", "DOI DOI 10.1002/(SICI)1097<1::AID>3", "doi:10.1234/AbC.5678, Doi: 10.1234/abc.5678", "https://doi.org/10.1016/j.cell.2020.01.001. end", "DOI 10.1/short", None)
    assert got[0] == ["10.1000/q.99999", "10.1000/xyz12345"] and "10.1002/(SICI)1097" in got[1] and got[2] == ["10.1234/AbC.5678", "10.1234/abc.5678"]
    assert got[3:] == [["10.1016/j.cell.2020.01.001."], [], []]


def test_keyword_conventions(spark):
    texts = ("['A', ' b ']", "a; B, c", "A, b", "[x, y]", "", None, "['a',]", "Review; x; Study A; a1; a1")
    assert values(spark, P.keywords_by_first_separator, *texts) == [["A", " b "], ["a", "b, c"], ["a", "b"], ["[x", "y]"], [""], [], ["a"], ["review", "x", "study a", "a1", "a1"]]
    assert values(spark, P.keywords_without_stops, *texts) == [[], [], [], ["[x, y]"], [], [], [], ["a1", "study a"]]
    assert values(spark, P.keywords_by_comma_or_semicolon, *texts)[1:5] == [["a", "b", "c"], ["a", "b"], ["[x", "y]"], []]
    assert values(spark, P.keywords_of_themes, *texts)[:4] == [["a", "b"], ["a", "b, c"], ["a", "b"], []]
    assert values(spark, lambda c: P.keywords_of_themes(c, "whole"), "[x, y]") == [["[x, y]"]]
    assert values(spark, P.categories_list, "Eng, Bio; Math", "['Eng, Bio']", "Eng, Bio", "[bad", "[bad]", None, "A/B") == [["Eng, Bio", "Math"], ["Eng, Bio"], ["Eng, Bio"], ["[bad"], [], [], ["A", "B"]]
    assert values(spark, P.refs_lenient, "['a','a']", "[a, 'b]", "", "[]", None) == [["a", "a"], ["a", "b"], [], [], []]
    assert values(spark, P.refs_of_literal, "['a','a']", "[a]", "a", None, '["a\\"b\'c", \'y\']') == [["a"], [], [], [], ["a\"b'c", "y"]]


def test_scalars(spark):
    assert values(spark, P.bare_doi, " https://doi.org/10.1/A ", "doi:10.1/a", "10.1/a") == ["10.1/A", "10.1/a", "10.1/a"]
    assert values(spark, P.clean_text, "See http://x.y/z NOW, 12 cafés!", None, "") == ["see now cafés", "", ""]
    assert values(spark, P.is_conference, "Proc. of X", "Annals 2021", "Annals 1999", None, "Workshop") == [True, True, False, False, True]
    assert values(spark, P.year_of, "2019", " 2019.0 ", "2019-05", "n.d.", None) == [2019, 2019, None, None, None]
    assert values(spark, lambda c: P.shortened(c, 3), "abcd", "abc", None) == ["abc...", "abc", None]
    assert values(spark, lambda c: P.percent(c.cast("double"), 600), "0.5", None) == [300.0, 0.0]


def test_themes(spark):
    rows = spark.createDataFrame([("j", i, ["b", "a"] if i % 2 else ["a", "c"]) for i in range(5)] + [("k", 9, ["z"]), (None, 10, ["q"])], "periodical string, row_no int, keywords array<string>")
    top = themes.top_keywords(themes.periodical_keywords(rows, 5), 2)
    assert sorted((r.periodical, r.place, r.keyword, r.n) for r in top.collect()) == [("j", 1, "a", 5), ("j", 2, "c", 3)]
    asked = themes.prompts(top, "%s|%s")
    assert [r.prompt for r in asked.collect()] == ["j|a, c"]
    assert [r.reply for r in themes.describe(asked).collect()] == ["no description"]
    lines = ['data: {"choices":[{"delta":{"content":"On"}}]}', "", ": ping", 'data: {"choices":[{"delta":{"content":null}}]}', "data: {broken", 'data: {"choices":[{"delta":{"content":"e"}}]}', "data: [DONE]"]
    assert themes.stream_text(lines) == "One"
    assert [r.reply for r in themes.describe(asked, lambda p: lines).collect()] == ["One"]


def test_columns_by_alias(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int").toDF("doi ", "Periodical", "left")
    aliases = {"DOI": ["DOI", "doi"], "Source Title": ["Source Title", "Periodical"], "Year": ["Year"]}
    assert ingest.map_columns(df, aliases).columns == ["DOI", "Source Title", "left"]
    assert ingest.map_columns(df, aliases, ["DOI"]).columns == ["DOI"]
    assert ingest.find_column(["x"], ["y"]) is None
    with pytest.raises(ValueError):
        ingest.Cleaning.from_config({"cleaning": {}})
    assert ingest.Cleaning.from_config({"data_source": {}, "cleaning": {"top_n": 3}, "field_mapping": {}}).top_n == 3


def test_rankings(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0), ("d", None)], "periodical string, s double")
    assert [r.periodical for r in ranking.ranked(df, "s").orderBy("rank").collect()] == ["c", "a", "b", "d"]
    assert [r.periodical for r in ranking.head(df, "s", 2).collect()] == ["c", "a"]
    only = ranking.summary(df.where("periodical = 'a'"), "s").first()
    assert (only.n, only["mean"], only["std"]) == (1, 1.0, None)


def test_papers_without_an_identifier_stand_alone(spark):
    rows = spark.createDataFrame([(4, None, ["a1", "b1"], 2020, "j", 1), (6, None, ["a1", "c1"], 2021, "j", 2), (8, "x", ["a1"], 2021, "j", 3), (10, "x", ["b1"], 2022, "k", 4)], "row long, id string, keywords array<string>, year int, periodical string, row_no int")
    got = {r.id: (r.keywords, r.year, r.periodical) for r in novelty.papers_by_doi(rows).collect()}
    assert got == {"paper_4": (["a1", "b1"], None, None), "paper_6": (["a1", "c1"], None, None), "x": (["b1"], 2021, "j")}


def test_timeline_reports_and_counters(spark):
    papers = spark.createDataFrame([(["a1", "b1", "a1"], 2023, ["d"]), (["a1", "c1"], 2020, []), (["x", "y"], None, ["d", "e"]), (["x"], None, None), (None, 2021, None)], "keywords array<string>, year int, dois array<string>")
    first = novelty.timeline(papers)
    assert [(r.k1, r.k2) for r in novelty.timeline_report(first, 2).collect()] == [("a1", "c1"), ("a1", "a1")]
    assert [(r.k1, r.k2) for r in novelty.timeline_report(first, since=2022).collect()] == [("a1", "a1"), ("a1", "b1")]
    stats = novelty.corpus_stats(papers, first).first().asDict()
    assert stats == {"n_papers": 5, "n_with_keywords": 4, "n_keywords": 8, "n_without_year": 2, "n_skipped": 1, "n_dois": 3, "n_distinct": 5, "n_pairs": 3}


def test_periodical_td(spark):
    rows = spark.createDataFrame([("j", 1.0), ("j", 2.03), ("k", 1.0), (None, 9.0)], "periodical string, td double")
    got = {r.periodical: (round(r.td_mean, 4), r.percent_mean, r.percent_std and round(r.percent_std, 4), r.n_papers) for r in diversity.periodical_td(rows).collect()}
    assert got["j"][:2] == (1.515, pytest.approx(7.55)) and got["k"] == (1.0, 5.0, None, 1) and set(got) == {"j", "k"}


def test_ranks_over_many_parts(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(1000).select(F.format_string("n%04d", "id").alias("periodical"), F.when(F.col("id") % 7 > 0, (F.col("id") % 50).cast("double")).alias("s"))
        got = [(r.periodical, r.s) for r in ranking.ranked(df, "s").orderBy("rank").collect()]
        assert got == sorted(((r.periodical, r.s) for r in df.collect()), key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
        assert [r["rank"] for r in ranking.ranked(df, "s").orderBy("rank").collect()] == list(range(1, 1001))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert ranking.ranked(df.limit(0), "s").count() == 0


def test_long_dictionaries_go_in_blocks(spark, monkeypatch):
    rng = random.Random(3)
    made = ["".join(rng.choices("abcdef", k=rng.randint(3, 9))) for _ in range(60)]
    terms = spark.createDataFrame([(rng.choice("xyz"), t) for t in made] + [(None, "abc"), ("x", None)], "field string, term string")
    words = spark.createDataFrame([(w[: rng.randint(2, 9)] + rng.choice(["", "a", "zz"]),) for w in made] + [(None,), ("",), ("É" * 3000,)], "keyword string")
    one = Counter(map(tuple, entropy.match_fields(words, terms).collect()))
    monkeypatch.setattr(entropy, "TERMS_A_BLOCK", 20)
    monkeypatch.setattr(entropy, "WORDS_A_GROUP", 10)
    assert Counter(map(tuple, entropy.match_fields(words, terms).collect())) == one and len(one) > 40
    pairs = [(r.field, r.term) for r in terms.collect() if r.field and r.term]
    for (w,) in {tuple(r) for r in words.where("keyword <> ''").collect()}:
        want = {f for f, t in pairs if t == w} or {f for f, t in pairs if difflib.SequenceMatcher(None, w, t).ratio() >= 0.75}
        assert {f for k, f in one if k == w.lower()} >= want if w.islower() else True
