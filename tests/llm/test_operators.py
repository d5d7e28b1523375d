import itertools
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import cooccurrence, dedup, mapping, mixing, pairs, term_frequency, visual
from citeloom.operators import skew


# Copies

def papers(spark, rows):
    return spark.createDataFrame([(i, d, c, b"x") for i, d, c in rows], "record_id long, DOI string, citing string, key binary")


COPIES = [
    (5, "10.1/A", "10.1/x; 10.1/y"), (2, "doi:10.1/a", "['10.1/Y', '10.1/x', '10.1/x']"), (9, "10.1/a", "10.1/x"), (3, "10.1/b", None), (4, "10.1/B.", "[]"), (6, None, "10.1/x"),
    (7, "nan", "10.1/x"), (8, "", None), (3, "10.1/b", None),
]


def test_copies(spark):
    df = papers(spark, COPIES)
    assert sorted(map(tuple, dedup.collapse_copies(df).collect())) == [(2, 2), (3, 3), (6, 1), (7, 1), (8, 1), (9, 1)]
    assert sorted(map(tuple, dedup.copy_pairs(df).collect())) == [(2, 5), (3, 4), (3, 4)]
    assert dedup.copy_pairs(df.limit(0)).count() == dedup.collapse_copies(df.limit(0)).count() == 0


def test_a_class_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(pairs, "HOT_KEYS", 20)
    rng = random.Random(0)
    rows = [(i, f"10.1/{'hot' if i % 3 == 0 else rng.randint(1, 200)}", "10.1/x") for i in range(600)]
    groups = defaultdict(list)
    for i, d, _ in rows:
        groups[d].append(i)
    got = set(map(tuple, dedup.copy_pairs(papers(spark, rows)).collect()))
    assert got == {p for g in groups.values() for p in itertools.combinations(sorted(g), 2)}
    assert sorted(map(tuple, dedup.collapse_copies(papers(spark, rows)).collect())) == sorted((min(g), len(g)) for g in groups.values())


# Mapping

TERMS = [(1, "drug-resistant dream recall"), (2, "long-term monitoring"), (3, "granular fabric tensor"), (4, 'the "slow" mode'), (5, '4" borehole'), (6, "open dataset"), (7, "collapsing fabric tensor"), (8, "Weaver's knot"), (9, "open dataset")]


@pytest.mark.parametrize(
    "typed,want",
    [
        ("open dataset", 6), ("open datasets", 6), ("opendataset", 6), ("open-dataset", 6), ("open_dataset", 6), ("#open dataset", 6), ("dataset, open", 6), ("a review of open datasets", 6), ("opne datset", 6),
        ("open dataset crawl", -1), ("dataset", -1), ("closed dataset", -1), ("granu. fabric tensor", 3), ("tensor granular fabric", 3), ("fabric tensor", -1), ("sheared fabric tensor", -1), ("drug-. dream recall", 1),
        ("drugr-esistant dream recall", 1), ("weavers knots", 8), ("4 borehole [1]", 5), ("slow modes, the", 4), ("tënsor, collapsing fabríc", 7), ("...", -1), ("", -1), ("x" * 5000, -1),
    ],
)
def test_terms(typed, want):
    assert mapping.TermIndex(TERMS).find(" ".join(typed.lower().split())) == want


def test_distance():
    assert [mapping.distance(*x, 2) for x in (("ab", "ba"), ("abc", "abc"), ("abc", "ac"), ("kitten", "sitting"), ("", "ab"), ("", "abc"))] == [1, 0, 1, 3, 2, 3]


def test_edits_are_found_and_strangers_are_not(spark, sf):
    terms = [tuple(r) for r in spark.read.parquet(f"{sf}/field_terms.parquet").select("term_id", "term").collect()]
    index, rng = mapping.TermIndex(terms), random.Random(2)
    hit = 0
    for i, term in terms:
        at = rng.randrange(1, len(term))
        typed = term[: at - 1] + term[at:] if rng.random() < 0.5 else term[:at] + rng.choice("aeiou") + term[at:]
        hit += index.find(" ".join(typed.lower().split())) == i
    assert hit >= 0.98 * len(terms)
    firsts = {t.split()[0] for _, t in terms}
    assert all(index.find(f"{a} bestiary") == -1 for a in firsts)


LONG = [(1, "photosynthesis"), (2, "deep learning"), (3, "alpha bravo charlie delta foxtrot golfing hotels")]


@pytest.mark.parametrize(
    "typed,want",
    [
        ("photosynthss", 1), ("phtosynthesi", 1), ("photoosynthesiss", 1), ("fotosynthesis", 1), ("photosnthss x", -1), ("recent advances in deep learning", 2), ("deep learning applications", 2),
        ("deep learning techniques", 2), ("advanced deep learning", 2), ("deeplearnig", 2), ("review of depelearning", 2), ("a study of deeplearning", 2), ("deep sea", -1), ("deep learning; deep learning", 2),
        ("hotels golfing foxtrot delta charlie bravo alpha", 3), ("hote. golf. foxtrot delta charlie bravo alph.", 3), ("hotels golfing foxtrot delta charlie alpha", -1), ("learning deep " * 3000, 2), ("x y " * 5000, -1),
    ],
)
def test_long_terms_and_two_edits(typed, want):
    assert mapping.TermIndex(LONG).find(" ".join(typed.lower().split())) == want


def test_assignment():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 6)
        cost = [[rng.choice([0, 1, 2, 3]) for _ in range(n)] for _ in range(n)]
        assert mapping.assignment(cost) == min(sum(cost[k][o] for k, o in enumerate(p)) for p in itertools.permutations(range(n)))


def misspelled(text, edits, rng):
    for _ in range(edits):
        at, c = rng.randrange(len(text)), rng.choice("abcdefghijklmnopqrstuvwxyz")
        text = rng.choice([text[:at] + text[at + 1 :], text[:at] + c + text[at:], text[:at] + c + text[at + 1 :], text[:at] + text[at : at + 2][::-1] + text[at + 2 :]])
    return " ".join(text.split())


@pytest.mark.parametrize("single", [True, False])
def test_recall_at_two_edits(spark, sf, single):
    terms = [(r[0], r[1].lower()) for r in spark.read.parquet(f"{sf}/field_terms.parquet").select("term_id", "term").collect()]
    if single:
        terms = list(enumerate(sorted({w for _, t in terms for w in mapping.words(t) if len(w) >= 8})))
    index, rng, hits = mapping.TermIndex(terms), random.Random(3), 0
    for i, term in terms:
        typed = misspelled(term, 2, rng)
        hits += index.find(typed) == i or typed in index.exact
    assert hits >= 0.95 * len(terms)


def test_candidates_are_those_of_brute_force(spark, sf):
    terms = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/field_terms.parquet").select("term_id", "term").collect()][:60]
    index, rng = mapping.TermIndex(terms), random.Random(4)
    for i, term in terms:
        typed = misspelled(term.lower().replace(" ", "", 1), rng.randint(1, 2), rng)
        parts = mapping.words(typed)
        near = [(mapping.distance("".join(parts), "".join(index.tokens[k]), 2), 0, k) for k in index.tokens]
        assert index.similar(typed, parts)[0] <= min(near)[0] or min(near)[0] > 2 or len(parts) == len(index.tokens[min(near)[2]])


def test_fillers_are_learned_and_long_lists_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(mapping, "VALUES_A_GROUP", 20)
    terms = [(k, f"{a} {b}") for k, (a, b) in enumerate(itertools.product(["granular", "collapsing", "weaving"], ["tensors", "lanterns", "harbours", "almanacs"]))] + [(90, None), (None, "ghost"), (91, "Granular Tensors")]
    rng = random.Random(5)
    typed = [f"{t} zzfiller" for _, t in terms[:9]] + ["granular tensors crawl", "tensors, zzfiller weaving", "zzfiller", "collapsinglanterns zzfiller", "Granular  tensors", "", "..."]
    typed += [misspelled(t, rng.randint(1, 3), rng) for _, t in terms[:12] for _ in range(4)] + ["granular tensors"] * 40
    rows = [(n, t.replace(";", "")) for n, t in enumerate(typed)] + [(None, "weaving harbours"), (5, None)]
    df, listed = spark.createDataFrame(rows, "record_id long, Keywords string"), spark.createDataFrame(terms, "term_id long, term string")
    one = Counter(map(tuple, mapping.map_values(df, listed).collect()))
    known = {r[3]: r[4] for r in one}
    assert known["granular tensors zzfiller"] == 0 and known["granular tensors crawl"] == -1 and known["zzfiller"] == -1 and known["collapsinglanterns zzfiller"] == 5
    monkeypatch.setattr(mapping, "TERMS_A_BLOCK", 5)
    assert Counter(map(tuple, mapping.map_values(df, listed).collect())) == one
    assert {r.term_id for r in mapping.map_values(df, listed, fillers=frozenset()).collect() if "zzfiller" in r.plain} == {-1}


def test_map_values(spark):
    terms = spark.createDataFrame(TERMS + [(10, None), (None, "ghost")], "term_id long, term string")
    df = spark.createDataFrame([(1, "open datasets; Open  Dataset; mystery"), (2, None), (None, "mystery"), (2, "")], "record_id long, Keywords string")
    rows = sorted(map(tuple, mapping.map_values(df, terms).collect()), key=str)
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in rows] == [(1, 1, "open datasets", 6, False), (1, 2, "open dataset", 6, True), (1, 3, "mystery", -1, False), (None, 1, "mystery", -1, False)]
    assert {r.term_id for r in mapping.map_values(df, terms.limit(0)).collect()} == {-1}
    assert mapping.map_values(df.limit(0), terms).count() == 0


# Pairs and terms

def item_rows(n=400, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    return [("f" if rng.random() < 0.8 else "g", [rng.choice([*words, "hot", "hot", None]) for _ in range(rng.choice([0, 1, 2, 5, 9]))]) for _ in range(n)]


@pytest.mark.parametrize("least,share,most", [(1, 0.0, 10**6), (3, 0.02, 10**6), (3, 0.02, 1)])
def test_pairs(spark, least, share, most, monkeypatch):
    monkeypatch.setattr(cooccurrence, "ENTRIES", 300)
    rows = item_rows()
    got = {(r.field_name, r.item_a, r.item_b): (r.n_ab, r.n_a, r.n_b, r.n, round(r.ratio, 9)) for r in cooccurrence.cooccurrence(spark.createDataFrame(rows, "field_name string, items array<string>"), least, share, most).collect()}
    want = {}
    for f in "fg":
        sets = [s for s in ({x for x in items if x} for g, items in rows if g == f) if s]
        one, two = Counter(x for s in sets for x in s), Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
        n = len(sets)
        want |= {(f, a, b): (m, one[a], one[b], n, round(m * n / (one[a] * one[b]), 9)) for (a, b), m in two.items() if m >= least and m >= share * n}
    assert got == want


def test_no_pairs(spark):
    none = spark.createDataFrame([], "field_name string, items array<string>")
    assert cooccurrence.cooccurrence(none).count() == cooccurrence.cooccurrence(none, 3, 0.1).count() == 0
    one = spark.createDataFrame([("f", ["a", "a"]), ("f", None), ("f", [])], "field_name string, items array<string>")
    assert cooccurrence.cooccurrence(one).count() == 0


def test_log_likelihood(spark):
    row = spark.createDataFrame([(10000, 120, 100, 60), (100, 50, 50, 25), (100, 100, 100, 100)], "n long, a long, b long, ab long")
    got = [r[0] for r in row.select(cooccurrence.log_likelihood(F.col("n"), F.col("a"), F.col("b"), F.col("ab"))).collect()]

    def brute(n, a, b, ab):
        cells = np.array([[ab, a - ab], [b - ab, n - a - b + ab]], float)
        expected = cells.sum(1, keepdims=True) @ cells.sum(0, keepdims=True) / n
        with np.errstate(divide="ignore", invalid="ignore"):
            return 2 * np.nansum(np.where(cells > 0, cells * np.log(cells / expected), 0))

    assert np.allclose(got, [brute(*r) for r in row.collect()], atol=1e-6)


@pytest.mark.parametrize("held", [50, 10**6])
def test_term_frequencies(spark, held, monkeypatch):
    monkeypatch.setattr(term_frequency, "HELD", held)
    rng = random.Random(5)
    rows = [(rng.choice([*range(-5, 200_000, 997), None]), [rng.choice(["a", "b", "c", None, f"r{rng.randint(0, 500)}"]) for _ in range(rng.randint(0, 6))]) for _ in range(1500)]
    got = {r.term: (r.occurrences, r.n_rows) for r in term_frequency.term_frequencies(spark.createDataFrame(rows, "id long, terms array<string>")).collect()}
    want = defaultdict(list)
    for i, terms in rows:
        for t in terms:
            if t:
                want[t].append(i)
    assert got == {t: (len(ids), len(set(ids))) for t, ids in want.items()}
    assert term_frequency.term_frequencies(spark.createDataFrame([], "id long, terms array<string>")).count() == 0


def test_containers():
    rng = np.random.default_rng(0)
    for sizes in ((3, 4), (5000, 10), (9000, 60000), (4096, 1), (1,)):
        sets = [np.unique(rng.integers(0, 65536, n)) for n in sizes]
        size, data = term_frequency.union([(len(s), term_frequency.pack(s)) for s in sets])
        assert list(term_frequency.unpack(size, data)) == sorted(set().union(*map(set, sets))) and size == len(set().union(*map(set, sets)))


def test_dense_identifiers(spark):
    rows = spark.range(150_000).select("id", F.array(F.lit("x"), F.when(F.col("id") % 2 == 0, "y").otherwise("x")).alias("terms"))
    got = {r.term: (r.occurrences, r.n_rows, r.mark) for r in term_frequency.marked(term_frequency.term_frequencies(rows), 150_000, common_share=0.6).collect()}
    assert got == {"x": (225_000, 150_000, "common"), "y": (75_000, 75_000, None)}


# Mix

def one_by_one(weights, seats, caps):
    out = dict.fromkeys(weights, 0)
    for _ in range(seats):
        open_ = [k for k in sorted(weights) if out[k] < caps.get(k, seats) and weights[k] > 0]
        if not open_:
            break
        out[max(open_, key=lambda k: (weights[k] / (2 * out[k] + 1), [-ord(c) for c in k]))] += 1
    return out


def test_apportionment():
    rng = random.Random(6)
    for _ in range(200):
        weights = {c: rng.choice([0, rng.random(), rng.randint(1, 5)]) for c in "abcdefg"[: rng.randint(1, 7)]}
        caps = {c: rng.randint(0, 60) for c in weights if rng.random() < 0.4}
        seats = rng.randint(0, 150)
        assert mixing.sainte_lague(weights, seats, caps) == one_by_one(weights, seats, caps)


def test_best_subset():
    rng = random.Random(8)
    for _ in range(300):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        target = rng.randint(0, 60)
        near = min(((abs(sum(c) - target), sum(c)) for n in range(len(sizes) + 1) for c in itertools.combinations(sizes, n)), default=(target, 0))
        taken = mixing.best_subset(sizes, target)
        assert sum(sizes[k] for k in taken) == near[1] and len(set(taken)) == len(taken)


def test_fill_closes_the_gap():
    # Small texts first would leave a gap that no small text is left for.
    sizes = np.array([21_251, 5_633, 10_000, 4_000, 3_000, 2_500, 404, 0])
    assert sizes[mixing.fill(sizes, 26_884)].sum() == 26_884
    rng = np.random.default_rng(1)
    many = rng.integers(1, 900, 4000)
    for target in (0, 1, 77, 12_345, 400_000, int(many.sum())):
        assert sizes[mixing.fill(sizes, 0)].sum() == 0 and many[mixing.fill(many, target)].sum() == target
    huge = np.array([50_000_000] * 300)
    assert huge[mixing.fill(huge, 130_000_000)].sum() == 150_000_000


def size(text):
    return F.size(F.split(text, " ")).cast("bigint")


def corpus(spark):
    rng = random.Random(7)
    docs = [(i, " ".join(f"t{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 30))), rng.choices(["big", "mid", "tiny", "odd"], [60, 30, 3, 7])[0]) for i in range(2500)]
    docs += [(9001, docs[0][1], "odd"), (9002, docs[0][1], docs[0][2]), (9003, None, "big"), (9004, "", "big"), (9005, "free text", None), docs[0], docs[1], (None, docs[2][1], "big"), (None, "no id", "mid")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string")


@pytest.mark.parametrize("total", [None, 100_000])
def test_mix(spark, total):
    weights = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.3, 2), ("tiny", 0.2, 5), ("gone", None, 1)], "source string, target_weight double, max_repeats int")
    docs = corpus(spark)
    copies, report = mixing.mix(docs, weights, size, total_tokens=total, seed=3, shards=3)
    rows = {r.source: r for r in report.collect()}
    most = {"big": 2, "mid": 2, "tiny": 5}
    assert all(r.repeats <= most.get(r.source, 0) for r in copies.collect())
    assert rows["odd"].mixed_tokens == rows[None].mixed_tokens == rows["gone"].mixed_tokens == 0
    if total is None:
        assert all(abs(rows[s].reached_share - w) < 0.01 for s, w in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)))
        # Each source is within half its smallest text of its share; one is at its cap.
        whole = min(most[s] * rows[s].available_tokens / w for s, w in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)))
        assert all(abs(rows[s].mixed_tokens - w * whole) <= 1.5 for s, w in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)))
    else:  # more than the corpus can give: all is repeated as often as allowed
        assert all(rows[s].mixed_tokens == most[s] * rows[s].available_tokens for s in most)
    assert copies.count() == docs.where("text <> ''").select("text").distinct().count()
    texts = docs.distinct().join(copies, "doc_id").where("repeats > 0").groupBy("text").agg(F.count("*").alias("n"))
    assert texts.where("n > 1").count() == 0
    again = mixing.mix(docs, weights, size, total_tokens=total, seed=3, shards=3)[0]
    assert again.exceptAll(copies).count() == 0


def test_empty_mix(spark):
    docs = corpus(spark)
    weights = spark.createDataFrame([("big", 1.0, 2)], "source string, target_weight double, max_repeats int")
    assert [r.mixed_tokens for r in mixing.mix(docs.limit(0), weights, size)[1].collect()] == [0]
    copies, report = mixing.mix(docs, weights.limit(0), size)
    assert copies.agg(F.sum("repeats")).first()[0] == 0 and all(r.reached_share == 0 for r in report.collect())


# One form

ALIKE = [
    ("café", "café"), ("Ångström", "Ångström"), ("ｗｉｄｅ １", "wide 1"), ("a b c　d", "a b c d"), ("a​b﻿­⁠", "ab"), ("раtһ", "path"), ("ΑΒΕ", "ABE"),
    ("non‐stop‑", "non-stop-"), ("ﬁne ﬃ", "fine ffi"), ("5 µm Ω", "5 μm Ω"), ("ậ", "ậ"), ("e​́", "é"), ("ӓ", "ä"), ("q̣̇", "q̣̇"), ("✔️", "✔"), ("ӓ", "ä"), ("K", "K"),
]
DIFFERENT = ["x2", "x²", "x₂", "résumé", "resume", "Resume", "naïve", "naive", "1", "l", "I", "-", "–", "−", "10⁻³", "10-3", "文", "文本", "ß", "ss", "…", "...", "½", "1/2"]


def test_forms(spark):
    rows = [(k, t) for k, p in enumerate(ALIKE) for t in p] + [(100 + k, t) for k, t in enumerate(DIFFERENT)]
    got = defaultdict(set)
    for r in visual.one_form(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add(r.form)
    for k, (a, b) in enumerate(ALIKE):
        assert len(got[k]) == 1, (a, b, got[k])
    singles = [next(iter(got[100 + k])) for k in range(len(DIFFERENT))]
    assert len(set(singles)) == len(DIFFERENT) and singles == [unicodedata.normalize("NFC", t) for t in DIFFERENT]


MORE = [
    ("한국어 각", unicodedata.normalize("NFD", "한국어 각")), ("값", "가\u11b9"), ("가\u0301", "\u1100\u200b\u1161\u0301"), ("ӏ", "l"), ("Ԍ", "G"), ("Ү", "Y"), ("օ", "o"), ("Ꭺ", "A"), ("don\u02bct", "don\u2019t"), ("ⅰⅳ", "iiv"), ("Ⅻ", "XII"),
    ("a\u180fb", "ab"), ("ｶﾞﾊﾟ", "ガパ"), ("ﾡ", "ㄱ"), ("e\u200b\u200d\u0301", "é"), ("é\ufe0f", "é"), ("ГПФ", "ΓΠΦ"), ("ꓮꓐ", "AB"), ("￣", "¯"), ("ȧ\u0323", "ạ\u0307"),
]
APART = ["ᄀ", "ᅡ", "ᄀ\u0301\u1161", "가\u1161", "각\u11a8", "β", "ß", "г", "r", "ı", "i", "σ", "o", "α", "a", "\u0301", "\u0301\u0302", "ｶ", "が"]


def test_more_forms(spark):
    rows = [(k, t) for k, p in enumerate(MORE) for t in p] + [(100 + k, t) for k, t in enumerate(APART)]
    got = defaultdict(set)
    for r in visual.one_form(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].add(r.form)
    for k, pair in enumerate(MORE):
        assert len(got[k]) == 1, (pair, got[k])
    assert len({next(iter(got[100 + k])) for k in range(len(APART))}) == len(APART)


def test_look_alikes_are_in_the_public_table(spark):
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    pairs_ = [(a, b) for seen, one in visual.ALIKE for a, b in zip(seen, one, strict=True)]
    left, right = (checker.getSkeleton("\n".join(x)).split("\n") for x in zip(*pairs_))
    # The table puts the small palochka elsewhere; it is a plain upright stroke like l.
    assert [p for p, a, b in zip(pairs_, left, right) if a != b] == [("ӏ", "l")]


def test_hangul_is_composed_by_the_standard_rule(spark):
    rng = random.Random(9)
    texts = ["".join(chr(rng.choice([*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3), *range(0xAC00, 0xAC60), 0x301, 0x323])) for _ in range(20)) for _ in range(200)]
    for r in visual.one_form(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        assert r.form == unicodedata.normalize("NFC", texts[r.doc_id]), texts[r.doc_id].encode("unicode_escape")


@pytest.mark.parametrize("most", [10**6, 0])
def test_a_text_in_a_third_of_all_rows(spark, monkeypatch, most):
    monkeypatch.setattr(visual, "MOST_CLUSTERS", most)
    monkeypatch.setattr(visual, "MOST_ALIKE", most)
    monkeypatch.setattr(pairs, "HOT_KEYS", 20)
    monkeypatch.setattr(skew, "HEAVY_KEYS", 2)
    texts = ["cafe\u0301", "café", "раth", "path", "сafé", "x\u0323\u0301y", "other", None, "\u200b"]
    rows = [(i, texts[0] if i % 3 == 0 else texts[i % 9]) for i in range(90)] + [(None, "café")]
    same = {0: 0, 1: 0, 4: 0, 2: 1, 3: 1}
    form = lambda t: same.get(texts.index(t)) if t in texts else None
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(a, b) for (a, s), (b, t) in itertools.combinations(rows[:90], 2) if s and t and s != t and form(s) is not None and form(s) == form(t)}
    got = [tuple(r) for r in visual.alike_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)
    assert visual.one_form(df).where("form = 'café'").count() == sum(form(t) == 0 for _, t in rows if t)


def test_recomposition_is_the_standard_one(spark):
    rng = random.Random(8)
    marks = [chr(c) for c in (0x301, 0x302, 0x308, 0x323, 0x327, 0x30A, 0x31B, 0x345, 0x5B0)]
    texts = ["".join(rng.choice("aeouAicén ǖ漢") + "".join(rng.choices(marks, k=rng.choice([0, 0, 1, 2, 3]))) for _ in range(12)) for _ in range(200)] + ["́x", "e" + "́" * 500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in visual.one_form(df).collect():
        assert r.form == unicodedata.normalize("NFC", texts[r.doc_id])


def test_alike_pairs(spark):
    rows = [(1, "path"), (2, "раth"), (3, "path"), (4, "​"), (5, "  "), (6, None), (7, ""), (8, "Path"), (None, "pаth"), (2, "раth"), (9, "x" * 300_000 + "é"), (10, "x" * 300_000 + "é")]
    got = sorted(map(tuple, visual.alike_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, 2), (1, 2), (2, 3), (2, 3), (9, 10)]
    assert visual.alike_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
