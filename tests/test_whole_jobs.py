"""Queries on small tables of their own against brute force, where their SQL does only a part of the job."""

import difflib
import math
from collections import Counter, defaultdict

import pytest

from citeloom.operators import diversity
from citeloom.plans import reference

COLUMNS = "DOI string, `Source Title` string, `Publication Year` string, Keywords string, `WoS Categories` string, citing string, citations string, `Article Title` string, Abstract string"
TERMS = [("cs", "neural networks"), ("cs", "deep learning"), ("bio", "brain"), ("bio", "Gene Expression"), ("art", "brain"), ("art", "genre expression")]
KEYWORDS = [
    ("j", "neural netwroks; brain; tides"), ("j", "Brains, deep learning"), ("j", "gene expresion; deep lerning; neural networks"), ("k", "tides"), ("k", None), (None, "['Brain', 'brains', 'brain']"),
    ("k", "genre expressions; neural network; nothing near"),
]


def save(spark, folder, papers, **tables):
    """The two exports of papers {column: value}, the first in target_data, and further tables (rows, schema)."""
    names = [c.strip().split("` ")[0].strip("`").removesuffix(" string") for c in COLUMNS.split(",")]
    rows = [tuple(p.get(n) for n in names) for p in papers]
    spark.createDataFrame([(1, *rows[0])], f"row_no long, {COLUMNS}").write.parquet(f"{folder}/target_data.parquet")
    spark.createDataFrame([(n, *r) for n, r in enumerate(rows[1:], 1)], f"record_id long, {COLUMNS}").write.parquet(f"{folder}/data_with_citing.parquet")
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def row_of(n):
    """The row of the n-th paper saved."""
    return 2 * n + 1 if n else 2


@pytest.fixture(scope="module")
def keyword_tables(spark, tmp_path_factory):
    papers = [{"Source Title": j, "Keywords": k} for j, k in KEYWORDS]
    return save(spark, tmp_path_factory.mktemp("keywords"), papers, field_terms=(TERMS, "field string, term string"))


def fields_by_hand(keyword):
    word, terms = keyword.lower().strip(), [(f, t.lower()) for f, t in TERMS]
    return {f for f, t in terms if t == word} or {f for f, t in terms if difflib.SequenceMatcher(None, word, t).ratio() >= 0.75}


def shares_by_hand():
    """{row: {field: hits}}."""
    out = {}
    for n, (_, text) in enumerate(KEYWORDS):
        words = {"Brain", "brains", "brain"} if (text or "").startswith("[") else {w.strip().lower() for w in (text or "").replace(";", ",").split(",")} - {""}
        hits = Counter(f for w in words for f in fields_by_hand(w))
        if hits:
            out[row_of(n)] = hits
    return out


def bits(hits):
    return abs(-sum(n / hits.total() * math.log2(n / hits.total()) for n in hits.values()))


def test_shares_count_similar_keywords(spark, keyword_tables):
    got = {(r.row, r.field): (r.n, r.share) for r in reference.field_shares(spark, keyword_tables).collect()}
    assert got == {(row, f): (n, round(n / hits.total(), 6)) for row, hits in shares_by_hand().items() for f, n in hits.items()}
    assert got[row_of(0), "cs"][0] == 1  # only by similarity


def test_entropy_counts_similar_keywords(spark, keyword_tables):
    got = {r.row: (r.n_fields, r.entropy) for r in reference.paper_entropy(spark, keyword_tables).collect()}
    assert got == {row: (len(hits), round(bits(hits), 6)) for row, hits in shares_by_hand().items()}


def test_periodicals_count_similar_keywords(spark, keyword_tables):
    by_row, want = shares_by_hand(), defaultdict(list)
    for n, (periodical, _) in enumerate(KEYWORDS):
        hits = by_row.get(row_of(n), Counter())
        want[periodical or "Unknown"].append((bits(hits) if hits else 0.0, len(hits)))
    for r in reference.periodical_entropy(spark, keyword_tables).collect():
        rows = want.pop(r.periodical)
        mean = sum(e for e, _ in rows) / len(rows)
        assert (r.n_papers, r.entropy_mean, r.fields_mean) == (len(rows), pytest.approx(mean, abs=1e-6), pytest.approx(sum(f for _, f in rows) / len(rows), abs=1e-6))
        assert r.percent_score == pytest.approx(mean * 500, abs=1e-3)
    assert not want


CATEGORIES = ["a; b", "A;b", "b; c", "c. d; b; e", "f", "g; g", None]


def test_matrix_has_all_categories(spark, tmp_path):
    sf = save(spark, tmp_path / "t", [{"DOI": str(n), "WoS Categories": c} for n, c in enumerate(CATEGORIES)])
    counts = Counter()
    for text in CATEGORIES:
        cs = [c.strip() for c in (text or "").split(";")]
        counts.update((a, b) for a in cs for b in cs if len(cs) > 1)
    names = sorted({a for a, _ in counts})
    norm = {a: math.sqrt(sum(counts[a, c] ** 2 for c in names)) for a in names}
    want = {a: [1.0 if a == b else round(sum(counts[a, c] * counts[b, c] for c in names) / norm[a] / norm[b], 6) for b in names] for a in names}
    got = {r.category: r for r in reference.similarity_matrix_wide(spark, sf).collect()}
    assert names == ["A", "a", "b", "c", "c. d", "e", "g"] and set(got) == set(names)
    assert {a: [r[f"s{k}"] for k in range(len(names))] for a, r in got.items()} == want
    assert [got[a].place for a in names] == list(range(len(names)))
    with pytest.raises(ValueError):
        diversity.names_of(spark.createDataFrame([("a", "a"), ("b", "b")], "i string, j string"), 1)


ABSTRACTS = [
    ("Tides; the moon", "The tides, THE tides of 2020: see http://x.y/moon; moon moon moon and sand.", "Whole title, not a term"),
    (None, " ".join(f"word{chr(97 + n)} " * (2 if n > 9 else 1) for n in range(20)), "Title"),
    ("moon, Moon", None, "Title"),
    (None, None, "Title"),
    ("['Moon']", "moon a1 an ox", "Title"),
]


def test_terms_come_from_abstracts(spark, tmp_path):
    sf = save(spark, tmp_path / "t", [{"Keywords": k, "Abstract": a, "Article Title": t} for k, a, t in ABSTRACTS])
    got = sorted((r.row, r.term) for r in reference.term_source_both(spark, sf).collect())
    # Words in two places first, then by place: k to t, and a to e.
    want = {0: ["tides", "the moon", "moon", "see", "sand"], 1: [f"word{c}" for c in "klmnopqrstabcde"], 2: ["moon"], 4: ["Moon", "moon"]}
    assert got == sorted((row_of(n), t) for n, ts in want.items() for t in ts)
