"""Freely typed values mapped to a canonical list."""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.packed import KEYWORDS, Layout, split_packed
from citeloom.functions.text import pick, plain_form
from citeloom.operators.skew import lookup
from citeloom.session import materialize

#: Words that add nothing to a value beside a term, whatever the list: function words and words of titles.
#: A start only; `learned_fillers` finds those of the data. A parameter of the index.
FILLERS = frozenset(
    "a an the of on in at for and or with without to from into by about towards toward under over between among through via per as its their some new novel recent modern current general advanced "
    "improved basic special other various role roles study studies analysis analyses review reviews survey surveys overview introduction perspective perspectives approach approaches method methods "
    "technique techniques application applications advance advances progress trend trends issue issues topic topics aspect aspects case cases effect effects impact influence use using based "
    "problem problems research theory practice".split()
)
#: A worker holds the index of so many terms at a time; a longer list is cut into blocks of that size.
TERMS_A_BLOCK = 20_000
#: Distinct values that one task compares with one block of a long list.
VALUES_A_GROUP = 50_000
#: A word is a filler if it stands beside this share of the terms, and beside FILLER_TERMS terms at least.
FILLER_SHARE, FILLER_TERMS = 0.05, 3
UNMATCHED = -1
#: Written together, a value shorter than this is not compared by edits.
LEAST_JOINED = 8


def fold(text: str) -> str:
    """Lower-case without accents, apostrophes and quotes."""
    text = unicodedata.normalize("NFKD", text.lower())
    return re.sub("['\"’‘“”`]", "", "".join(c for c in text if not unicodedata.combining(c)))


def words(text: str) -> list[str]:
    """Folded words; one that ends in a full stop keeps it, as it may be shortened."""
    return re.findall(r"[^\W_]+\.?", fold(text))


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b, or most + 1 if more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    # Equal ends cost nothing; what is left between them is short.
    start, ends = 0, min(len(a), len(b))
    while start < ends and a[start] == b[start]:
        start += 1
    a, b = a[start:], b[start:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    # Each letter that only one has costs an edit.
    if max(len(set(a).difference(b)), len(set(b).difference(a))) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def shorter(word: str, by: int) -> set[str]:
    """The word and all words that lack up to `by` of its letters. Two words within `by` edits have one in common."""
    out = new = {word}
    for _ in range(by):
        new = {w[:i] + w[i + 1 :] for w in new for i in range(len(w))}
        out = out | new
    return out


def segments(text: str, n: int) -> list[tuple[int, str]]:
    """(start, part): the text in n parts whose lengths differ by one at most."""
    cuts = [k * len(text) // n for k in range(n + 1)]
    return [(a, text[a:b]) for a, b in itertools.pairwise(cuts)]


def assignment(cost: list[list[int]]) -> int:
    """Least total of a square table with one cell taken in each row and column (shortest augmenting paths)."""
    n = len(cost)
    by_row, by_column = [0] * n, [0] * n  # potentials
    row_of: list[int | None] = [None] * n
    for r in range(n):
        least, via, done = [float("inf")] * n, [-1] * n, [False] * n
        row, at = r, -1
        while True:
            step, nxt = float("inf"), -1
            for c in range(n):
                if not done[c]:
                    d = cost[row][c] - by_row[row] - by_column[c]
                    if d < least[c]:
                        least[c], via[c] = d, at
                    if least[c] < step:
                        step, nxt = least[c], c
            by_row[r] += step
            for c in range(n):
                if done[c]:
                    by_row[row_of[c]] += step
                    by_column[c] -= step
                else:
                    least[c] -= step
            done[nxt], at = True, nxt
            if row_of[at] is None:
                break
            row = row_of[at]
        while at != -1:
            row_of[at] = r if via[at] == -1 else row_of[via[at]]
            at = via[at]
    return sum(cost[r][c] for c, r in enumerate(row_of))


class TermIndex:
    """Finds the term a value stands for.

    1. Equal plain form. 2. Equal when written together. 3. A multi-pattern automaton over terms and
    their aliases (inflected, reordered) finds embedded mentions; the longest non-overlapping wins, and
    the value stands for it if nothing but filler words is left. 4. Token-set similarity for the rest:
    every word must pair with a word of the term, in the cheapest assignment at most `most_edits` edits
    in all (a word of fewer than five letters one at most); a word with a full stop pairs with any word
    it begins. Words written together or cut elsewhere are compared as a whole. Of equally near terms
    the least id wins.

    No candidate is lost: words within the edits share a word lacking as many letters, and of a text
    cut into 2 `most_edits` + 1 segments one at least stands unchanged in any text within the edits.
    """

    def __init__(self, terms: Iterable[tuple[int, str]], fillers: frozenset[str] = FILLERS, most_edits: int = 2):
        self.fillers, self.most_edits = fillers, most_edits
        self.exact: dict[str, int] = {}
        self.tokens: dict[int, list[str]] = {}
        self.written: dict[int, list[str]] = {}
        self.joined: dict[str, int] = {}
        aliases: dict[str, int] = {}
        self.by_word: dict[str, list[int]] = defaultdict(list)
        self.near: dict[str, set[str]] = defaultdict(set)
        self.begins: dict[str, set[str]] = defaultdict(set)
        self.parts_of: dict[tuple[int, int, str], list[int]] = defaultdict(list)
        self.measured: dict[tuple[str, str], int] = {}
        self.alike: dict[str, set[str]] = {}
        for i, term in sorted(t for t in terms if t[0] is not None and t[1]):
            plain = " ".join(term.lower().split())
            parts = [w.rstrip(".") for w in words(term)]
            if not parts or plain in self.exact:
                continue
            self.exact[plain] = i
            self.tokens[i] = parts
            self.written[i] = fold(term).split()
            for alias in self._aliases(parts):
                aliases.setdefault(" ".join(alias), i)
                self.joined.setdefault("".join(alias), i)
            for w in set(parts):
                self.by_word[w].append(i)
            whole = "".join(parts)
            if len(whole) >= LEAST_JOINED - most_edits:
                for start, part in segments(whole, 2 * most_edits + 1):
                    self.parts_of[len(whole), start, part].append(i)
        self.longest = max(map(len, self.by_word), default=0)
        self.whole_lengths = {k[0] for k in self.parts_of}
        for w in self.by_word:
            for s in shorter(w, most_edits):
                self.near[s].add(w)
            for k in range(3, len(w)):
                self.begins[w[:k]].add(w)
        self.automaton = ahocorasick.Automaton()
        for alias, i in aliases.items():
            self.automaton.add_word(f" {alias} ", (len(alias) + 2, i))
        if aliases:
            self.automaton.make_automaton()
        self.usable = bool(aliases)

    @staticmethod
    def _aliases(parts: list[str]) -> Iterator[list[str]]:
        last = parts[-1]
        ends = [last, last + "s", last + "es"]
        if last.endswith("y"):
            ends.append(last[:-1] + "ies")
        if last.endswith("is"):
            ends.append(last[:-2] + "es")
        for end in ends:
            yield [*parts[:-1], end]
            if len(parts) > 1:
                yield [end, *parts[:-1]]

    def find(self, plain: str) -> int:
        """Id of the term that a plain form stands for, -1 if none."""
        if plain in self.exact:
            return self.exact[plain]
        typed = words(plain) if self.usable else []
        if not typed:
            return UNMATCHED
        found = self.together(typed)
        if found is None:
            mention = self.mention(typed)
            found = mention[2] if mention and not self.strange(mention[3]) else None
        return self.similar(plain, typed)[2] if found is None else found

    def strange(self, rest: list[str]) -> list[str]:
        """The words that are no fillers."""
        return [w for w in rest if w not in self.fillers and not w.isdigit()]

    def together(self, typed: list[str]) -> int | None:
        """The term equal to the words written together, with the fillers or without."""
        parts = [w.rstrip(".") for w in typed]
        found = self.joined.get("".join(parts))
        return self.joined.get("".join(self.strange(parts))) if found is None else found

    def mention(self, typed: list[str]) -> tuple[int, int, int, list[str]] | None:
        """(-length, start, id, words left) of the longest mention; other mentions of its term aren't left."""
        text = f" {' '.join(w.rstrip('.') for w in typed)} "
        hits = [(-n, end - n + 1, i) for end, (n, i) in self.automaton.iter(text)]
        if not hits:
            return None
        first = min(hits)
        taken: list[tuple[int, int]] = []
        for n, start, i in sorted(h for h in hits if h[2] == first[2]):
            if all(start - n - 1 <= s or start >= e - 1 for s, e in taken):  # neighbours share a space
                taken.append((start, start - n))
        left, at = [], 0
        for start, end in sorted(taken):
            left.append(text[at:start])
            at = max(at, end)
        return *first, " ".join([*left, text[at:]]).split()

    def similar(self, plain: str, typed: list[str]) -> tuple[int, int, int]:
        """(edits, 1 if the order differs, id) of the nearest term, id -1 if none is near enough."""
        written = fold(plain).split()
        lean = [w for w in typed if w not in self.fillers]
        best = none = (self.most_edits + 1, 0, UNMATCHED)
        for attempt in ([typed, lean] if lean != typed else [typed]):
            if attempt:
                best = min(best, self._nearest(attempt, written))
        return best if best[0] <= self.most_edits else none

    def _like(self, typed: str) -> set[str]:
        """Words of terms that a typed word may stand for."""
        found = self.alike.get(typed)
        if found is None:
            word = typed.rstrip(".")
            found = set(self.begins.get(word, ())) if typed.endswith(".") else set()
            if len(word) <= self.longest + self.most_edits:
                found = found.union(*(self.near.get(s, ()) for s in shorter(word, self.most_edits)))
            if len(self.alike) >= 200_000:
                self.alike.clear()
            self.alike[typed] = found
        return found

    def _whole_like(self, together: str) -> set[int]:
        """Terms that have a segment where the whole text, shifted by the edits at most, has it too."""
        found: set[int] = set()
        e = self.most_edits
        for size in range(len(together) - e, len(together) + e + 1):
            if size in self.whole_lengths:
                for start, part in segments("x" * size, 2 * e + 1):
                    for at in range(max(0, start - e), min(start + e, len(together) - len(part)) + 1):
                        if ids := self.parts_of.get((size, start, together[at : at + len(part)])):
                            found.update(ids)
        return found

    def _nearest(self, typed: list[str], written: list[str]) -> tuple[int, int, int]:
        votes: Counter[int] = Counter()
        for w in set(typed):
            votes.update({i for x in self._like(w) for i in self.by_word[x]})
        near = {i for i, n in votes.items() if n >= len(self.tokens[i]) - 1 or n >= len(typed) - 1}
        together = "".join(w.rstrip(".") for w in typed)
        whole = self._whole_like(together) if len(together) >= LEAST_JOINED else set()
        shortened = any(w.endswith(".") for w in written)
        best = (self.most_edits + 1, 0, UNMATCHED)
        for i in near | whole:
            parts = self.tokens[i]
            cost, moved = self._pairing(typed, parts) if i in near else (self.most_edits + 1, 1)
            if cost > self.most_edits and i in whole and (len(typed) != len(parts) or sum(w not in parts for w in typed) > 1):
                # Word ends may be in other places.
                cost, moved = distance(together, "".join(parts), self.most_edits), 0
            if cost > self.most_edits and shortened and i in near and len(written) == len(self.written[i]):
                # A word shortened within or beside its hyphen.
                cost, moved = sum(self._word(a, b) for a, b in zip(written, self.written[i])), 0
            best = min(best, (cost, moved, i))
        return best

    def _pairing(self, typed: list[str], parts: list[str]) -> tuple[int, int]:
        """(edits, 1 if the order differs) of the cheapest pairing of all words, by word order first."""
        too_many = self.most_edits + 1, 1
        if len(typed) != len(parts):
            return too_many
        straight = 0
        for a, b in zip(typed, parts):
            straight += self._word(a, b)
            if straight > self.most_edits:
                break
        else:
            return straight, 0
        # A word that isn't shortened costs an edit if the term hasn't got it, so most terms need no table.
        spare = Counter(parts)
        unequal = 0
        for w in typed:
            if spare[w] > 0:
                spare[w] -= 1
            elif not w.endswith("."):
                unequal += 1
                if unequal > self.most_edits:
                    return too_many
        return min(assignment([[self._word(a, b) for b in parts] for a in typed]), self.most_edits + 1), 1

    def _word(self, typed: str, part: str) -> int:
        if typed.endswith(".") and len(typed) > 3 and part.startswith(typed[:-1]):
            return 0
        known = self.measured.get((typed, part))
        if known is None:
            word = typed.rstrip(".")
            most = 1 if min(len(word), len(part)) < 5 else self.most_edits
            d = distance(word, part, most)
            if len(self.measured) >= 500_000:
                self.measured.clear()
            known = self.measured[typed, part] = d if d <= most else self.most_edits + 1
        return known


_indexes: dict[tuple, TermIndex] = {}


def shared_index(terms: tuple[tuple[int, str], ...], fillers: frozenset[str]) -> TermIndex:
    """The index of a list, built once per worker process."""
    key = (terms, fillers)
    if key not in _indexes:
        if len(_indexes) >= 4:
            _indexes.clear()
        _indexes[key] = TermIndex(terms, fillers)
    return _indexes[key]


def _enough(n_terms: int) -> int:
    return max(FILLER_TERMS, -int(-FILLER_SHARE * n_terms // 1))


def _words_of(terms: Iterable[tuple[int, str]]) -> set[str]:
    return {w.rstrip(".") for _, t in terms if t for w in words(t)}


def learned_fillers(values: DataFrame, terms: tuple[tuple[int, str], ...]) -> frozenset[str]:
    """Words of the values (plain) that stand beside many terms and are in none.

    Each task hands on each (word, term) once, so that at most words x terms rows are shuffled,
    however many the values. The answer has the size of a word list.
    """

    def beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared_index(terms, FILLERS)
        seen: set[str] = set()
        sent: set[tuple[str, int]] = set()
        for batch in batches:
            new = []
            for plain in batch["plain"].unique():
                if plain in seen or plain in index.exact:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(plain)
                mention = index.mention(words(plain)) if index.usable else None
                if mention:
                    new += [p for w in index.strange(mention[3]) if (p := (w, mention[2])) not in sent]
                    sent.update(new)
            if len(sent) >= 1_000_000:
                sent.clear()
            yield pd.DataFrame(new, columns=["word", "term"])

    pairs = values.select("plain").mapInPandas(beside, "word string, term bigint")
    return _common(pairs, len(terms), _words_of(terms))


def _common(pairs: DataFrame, n_terms: int, inside: set[str]) -> frozenset[str]:
    often = pairs.distinct().groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= _enough(n_terms))
    return FILLERS | {r[0] for r in often.select("word").collect()} - inside


def _single(values: DataFrame, terms: tuple[tuple[int, str], ...], fillers: frozenset[str], cache: int) -> DataFrame:
    @F.pandas_udf("struct<term_id: bigint, exact: boolean>")
    def resolve(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = shared_index(terms, fillers)
        known: dict[str, int] = {}
        for batch in batches:
            codes, distinct = pd.factorize(batch)
            ids = []
            for plain in distinct:
                got = known.get(plain)
                if got is None:
                    if len(known) >= cache:
                        known.clear()
                    got = known[plain] = index.find(plain)
                ids.append(got)
            frame = pd.DataFrame({"term_id": pd.Series(ids, dtype="int64"), "exact": pd.Series([p in index.exact for p in distinct], dtype="bool")})
            yield frame.take(codes).reset_index(drop=True)

    return values.withColumn("found", resolve("plain")).select("id", "pos", "value", "plain", "found.term_id", "found.exact")


def _in_blocks(values: DataFrame, terms: DataFrame, n_terms: int, fillers: frozenset[str] | None) -> DataFrame:
    """As `_single`, for a list of any length: distinct values meet the list block by block and the best answer of all blocks counts.

    A task holds VALUES_A_GROUP values and TERMS_A_BLOCK terms. The list never is in one place.
    """
    blocks = -(-n_terms // TERMS_A_BLOCK)
    distinct = materialize(values.select("plain").distinct())
    salts = 1 + distinct.count() // VALUES_A_GROUP
    listed = terms.select(F.pmod(F.xxhash64("i"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "i", "t")

    def compare(asked: DataFrame, run, schema: str) -> DataFrame:
        spread = asked.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"), F.pmod(F.xxhash64("plain"), F.lit(salts)).cast("int").alias("salt"), "plain")
        return spread.groupBy("block", "salt").cogroup(listed.groupBy("block", "salt")).applyInPandas(run, schema)

    def first(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        index = TermIndex(zip(block["i"].tolist(), block["t"].tolist()), FILLERS if fillers is None else fillers)
        out = []
        for plain in asked["plain"]:
            typed = words(plain) if index.usable else []
            found = index.mention(typed) if typed else None
            mention = None if found is None else {"length": found[0], "start": found[1], "i": found[2], "rest": index.strange(found[3])}
            out.append((plain, index.exact.get(plain), mention))
        return pd.DataFrame({"plain": [r[0] for r in out], "exact": pd.array([r[1] for r in out], "Int64"), "mention": pd.Series([r[2] for r in out], dtype=object)})

    seen = compare(distinct, first, "plain string, exact bigint, mention struct<length: int, start: int, i: bigint, rest: array<string>>")
    seen = materialize(seen.groupBy("plain").agg(F.min("exact").alias("exact"), F.min("mention").alias("mention")))
    if fillers is None:
        inside = terms.select(F.explode(_word_list(F.col("t"))).alias("word")).distinct()
        pairs = seen.where("exact is null").select(F.explode("mention.rest").alias("word"), F.col("mention.i").alias("term"))
        fillers = _common(pairs.join(inside, "word", "left_anti"), n_terms, set())
    open_ = seen.where("exact is null")

    def second(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        index = TermIndex(zip(block["i"].tolist(), block["t"].tolist()), fillers)
        out = []
        for plain in asked["plain"]:
            typed = words(plain) if index.usable else []
            cost, moved, i = index.similar(plain, typed) if typed else (index.most_edits + 1, 0, UNMATCHED)
            out.append((plain, index.together(typed) if typed else None, cost, moved, i))
        frame = pd.DataFrame(out, columns=["plain", "together", "cost", "moved", "i"])
        return frame.assign(together=frame["together"].astype("Int64"))

    near = compare(open_.select("plain"), second, "plain string, together bigint, cost int, moved int, i bigint")
    near = near.groupBy("plain").agg(F.min("together").alias("together"), F.min(F.struct("cost", "moved", "i")).alias("near"))
    known = F.array(*map(F.lit, sorted(fillers))) if fillers else F.array().cast("array<string>")
    left = F.size(F.array_except("mention.rest", known))
    named = F.when(left == 0, F.col("mention.i"))
    answers = open_.join(near, "plain").select("plain", F.coalesce("together", named, "near.i").alias("term_id"), F.lit(False).alias("exact"))
    answers = answers.unionByName(seen.where("exact is not null").select("plain", F.col("exact").alias("term_id"), F.lit(True).alias("exact")))
    return lookup(values, materialize(answers), "plain").select("id", "pos", "value", "plain", "term_id", "exact")


def _word_list(text):
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w.rstrip(".") for w in words(t)] if t else [])

    return run(text)


def map_values(df: DataFrame, terms: DataFrame, id_column: str = "record_id", column: str = "Keywords", layout: Layout = KEYWORDS, term_column: str = "term", term_id: str = "term_id", fillers: frozenset[str] | None = None, cache: int = 200_000) -> DataFrame:
    """(record_id, pos, value, plain, term_id, exact): every value with the term it stands for, -1 if none.

    A list of up to TERMS_A_BLOCK terms goes to the workers and the values stay where they are, so there
    is no shuffle of values, and no value however frequent weighs on one task. Each worker builds the
    index once and keeps up to `cache` answers. A longer list is taken block by block, with the same
    result. Without `fillers` they are FILLERS and those learned from the values.

    Of equal terms the one with the least id counts. Null and empty fields give no row; an empty list
    leaves every value unmatched; repeated rows and values come out as they stand.
    """
    listed = pick(terms, {"i": term_id, "t": term_column}).where("i is not null and t is not null and t <> ''").select(F.col("i").cast("bigint").alias("i"), "t")
    rows = split_packed(pick(df, {"id": id_column, "packed": column}), "packed", "vals", layout)
    values = rows.select("id", F.posexplode_outer("vals").alias("pos", "value")).where("value is not null")
    values = values.select("id", (F.col("pos") + 1).cast("int").alias("pos"), "value", plain_form(F.col("value")).alias("plain"))
    held = listed.limit(TERMS_A_BLOCK + 1).collect()
    if len(held) <= TERMS_A_BLOCK:
        block = tuple(sorted(map(tuple, held)))
        found = _single(values, block, learned_fillers(values, block) if fillers is None else fillers, cache)
    else:
        found = _in_blocks(materialize(values), materialize(listed), listed.count(), fillers)
    return found.withColumnRenamed("id", id_column)
