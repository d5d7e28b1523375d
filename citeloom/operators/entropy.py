"""Fields of keywords and their entropy (OP-46, OP-47, OP-61 to OP-63)."""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.operators.skew import attach
from citeloom.session import materialize

#: A worker compares with so many (field, term) rows at a time; a longer dictionary is cut into blocks of that size.
TERMS_A_BLOCK = 50_000
#: Distinct keywords that one task compares with one block of a long dictionary, and words compared at once.
WORDS_A_GROUP, AT_ONCE = 50_000, 256
BUCKETS = 64


def _letters(texts: Sequence[str]) -> np.ndarray:
    """How often each letter (by its code's remainder) stands in each text."""
    out = np.zeros((len(texts), BUCKETS), np.int32)
    for k, text in enumerate(texts):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32) % BUCKETS
        out[k] = np.bincount(codes, minlength=BUCKETS)
    return out


class Dictionary:
    """Finds the fields of terms whose matching-blocks ratio to a word is at least `least`.

    Common letters and the lengths bound the ratio from above, for many words and all terms at once, and
    so does the longest common subsequence; only pairs that can reach it are compared. The ratio is asymmetric: word first, term second; what it
    prepares of the second is kept per term.
    """

    def __init__(self, rows: Iterable[tuple[str, str]], least: float):
        fields: dict[str, list[str]] = {}
        for field, term in sorted((f, t) for f, t in rows if f is not None and t is not None):
            fields.setdefault(term, []).append(field)
        self.terms, self.least = sorted(fields), least
        self.fields = [fields[t] for t in self.terms]
        self.letters = _letters(self.terms)
        self.lengths = np.array([len(t) for t in self.terms], np.int64)
        self.matchers: dict[int, difflib.SequenceMatcher] = {}
        self.places: list[dict[str, int]] = []
        for t in self.terms:
            places: dict[str, int] = {}
            for k, c in enumerate(t):
                places[c] = places.get(c, 0) | 1 << k
            self.places.append(places)

    def _in_order(self, word: str, t: int) -> int:
        """Length of the longest common subsequence, a bit per letter of the term; matching blocks are one."""
        places, full = self.places[t], (1 << len(self.terms[t])) - 1
        left = full
        for c in word:
            hit = left & places.get(c, 0)
            left = (left + hit | left - hit) & full
        return len(self.terms[t]) - left.bit_count()

    def find(self, words: Sequence[str]) -> list[list[str]]:
        """The fields of each word, sorted."""
        found: list[set[str]] = [set() for _ in words]
        if not self.terms:
            return [[] for _ in words]
        for start in range(0, len(words), AT_ONCE):
            part = words[start : start + AT_ONCE]
            letters, lengths = _letters(part), np.array([len(w) for w in part], np.int64)
            need = self.least * (lengths[:, None] + self.lengths) - 1e-9
            common = np.minimum(lengths[:, None], self.lengths).astype(np.int64)
            near = np.nonzero(2.0 * common >= need)
            for k in range(0, len(near[0]), 100_000):
                i, j = near[0][k : k + 100_000], near[1][k : k + 100_000]
                close = 2.0 * np.minimum(letters[i], self.letters[j]).sum(axis=1, dtype=np.int64) >= need[i, j]
                for w, t in zip(i[close].tolist(), j[close].tolist()):
                    into = found[start + w]
                    if into.issuperset(self.fields[t]) or 2.0 * self._in_order(part[w], t) < need[w, t]:
                        continue
                    matcher = self.matchers.get(t)
                    if matcher is None:
                        matcher = self.matchers[t] = difflib.SequenceMatcher(None, "", self.terms[t])
                    matcher.set_seq1(part[w])
                    if matcher.ratio() >= self.least:
                        into.update(self.fields[t])
        return [sorted(f) for f in found]


_dictionaries: dict[tuple, Dictionary] = {}


def _shared(rows: tuple[tuple[str, str], ...], least: float) -> Dictionary:
    """Built once per worker process."""
    key = (rows, least)
    if key not in _dictionaries:
        _dictionaries.clear()
        _dictionaries[key] = Dictionary(rows, least)
    return _dictionaries[key]


def match_exact(keywords: DataFrame, dictionary: DataFrame) -> DataFrame:
    """OP-46: (keyword, field), each once; keywords are compared trimmed and lower-case with (field, term)."""
    words = keywords.select("keyword", F.lower(F.trim("keyword")).alias("term")).distinct()
    return words.join(dictionary.select("field", "term").distinct(), "term").select("keyword", "field").distinct()


def match_similar(keywords: DataFrame, dictionary: DataFrame, least: float = 0.75) -> DataFrame:
    """OP-47: (keyword, field) with a term whose matching-blocks ratio to the keyword is at least `least`.

    Runs once per distinct keyword, spread over the shuffle partitions. A dictionary of up to
    TERMS_A_BLOCK rows goes to the workers; a longer one meets the keywords block by block.
    """
    spark = keywords.sparkSession
    terms = dictionary.select("field", "term").where("field is not null and term is not null").distinct()
    words = keywords.where("keyword is not null").select("keyword").distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = terms.limit(TERMS_A_BLOCK + 1).collect()
    schema = "keyword string, fields array<string>"
    if len(held) <= TERMS_A_BLOCK:
        listed = tuple(sorted(map(tuple, held)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _shared(listed, least)
            for batch in batches:
                yield batch.assign(fields=index.find(batch["low"].tolist()))[["keyword", "fields"]]

        found = words.select("keyword", _low("keyword").alias("low")).repartition(parts, "keyword").mapInPandas(run, schema)
        return found.select("keyword", F.explode("fields").alias("field"))

    terms, words = materialize(terms), materialize(words)
    blocks, salts = -(-terms.count() // TERMS_A_BLOCK), 1 + words.count() // WORDS_A_GROUP
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    asked = words.select("keyword", _low("keyword").alias("low"), every(blocks).alias("block"), place("keyword", salts).alias("salt"))
    listed = terms.select("field", "term", place("term", blocks).alias("block"), every(salts).alias("salt"))

    def compare(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        index = Dictionary(zip(block["field"], block["term"]), least)
        return asked.assign(fields=index.find(asked["low"].tolist()))[["keyword", "fields"]]

    found = asked.groupBy("block", "salt").cogroup(listed.groupBy("block", "salt")).applyInPandas(compare, schema)
    return found.select("keyword", F.explode("fields").alias("field")).distinct()


def _low(name: str) -> Column:
    return F.lower(F.trim(name))


def match_fields(keywords: DataFrame, dictionary: DataFrame, least: float = 0.75) -> DataFrame:
    """(keyword, field): exact matches in any field; only keywords without one are compared by similarity."""
    exact = materialize(match_exact(keywords, dictionary))  # read twice below
    rest = keywords.select("keyword").distinct().join(exact, "keyword", "left_anti")
    return exact.unionByName(match_similar(rest, dictionary, least))


def field_shares(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """OP-61: (row, field, n, share) of rows (row, keyword); a keyword counts for each of its fields, shares are over hits."""
    fields = matches.groupBy("keyword").agg(F.collect_list("field").alias("fields"))  # as many as there are fields
    counts = attach(rows, fields, "keyword", "inner").select("row", F.explode("fields").alias("field")).groupBy("row", "field").agg(F.count("*").alias("n"))
    total = counts.groupBy("row").agg(F.sum("n").alias("total"))
    return counts.join(total, "row").select("row", "field", "n", (F.col("n") / F.col("total")).alias("share"))


def entropy(shares: DataFrame) -> DataFrame:
    """OP-62: (row, n_fields, entropy) in bits."""
    return shares.groupBy("row").agg(F.count("*").alias("n_fields"), F.abs(F.sum(-F.col("share") * F.log2("share"))).alias("entropy"))


def periodical_entropy(papers: DataFrame, entropies: DataFrame) -> DataFrame:
    """OP-63: (periodical, entropy_mean, fields_mean, n_papers) of rows (row, periodical); rows without a hit have entropy 0, null periodicals count as Unknown."""
    rows = papers.join(entropies, "row", "left").na.fill(0, ["entropy", "n_fields"])
    return rows.groupBy(F.coalesce("periodical", F.lit("Unknown")).alias("periodical")).agg(F.avg("entropy").alias("entropy_mean"), F.avg("n_fields").alias("fields_mean"), F.count("*").alias("n_papers"))
