"""Encoding of text with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern, and each piece is encoded by backtracking:

- An Aho-Corasick automaton over the reversed tokens gives, in one pass over the reversed piece, all
  tokens that begin at each byte, longest first.
- A pair-compatibility table says whether two tokens may stand side by side, that is whether merging
  in the order of ranks would leave the border between them. A sequence whose neighbours are all
  compatible is the one that merging gives.
- The longest token is tried at each place, then the shorter ones; a place from which no compatible
  continuation was found is marked and never tried again, so the work is linear in the piece.

Decoding joins the tokens' bytes by a table of offsets into one buffer.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Vocabulary:
    """Tokens by rank, read from a `.tiktoken` file: a token's id is the order of the merge that makes it."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.pattern = regex.compile(pattern)
        self.ids = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token
        self.halves = self._halves()
        self.merged = {pair: i for i, pair in enumerate(self.halves) if pair is not None}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token[::-1].decode("latin-1"), i)
        self.automaton.make_automaton()

    def _halves(self) -> list[tuple[int, int] | None]:
        """The two tokens whose merge makes each token; None for single bytes.

        The halves are what merging leaves of the token's bytes if only lower ranks may be used.
        """
        halves: list[tuple[int, int] | None] = [None] * len(self.tokens)
        for i, token in enumerate(self.tokens):
            if len(token) < 2:
                continue
            parts = [token[k : k + 1] for k in range(len(token))]
            while len(parts) > 2:
                best, at = i, -1
                for k in range(len(parts) - 1):
                    rank = self.ids.get(parts[k] + parts[k + 1], i)
                    if rank < best:
                        best, at = rank, k
                if at < 0:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                halves[i] = (self.ids[parts[0]], self.ids[parts[1]])
        return halves

    def fits(self, left: int, right: int) -> bool:
        """True if merging keeps the border between these two neighbouring tokens."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            known = self.compatible[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Undo merges from the latest on. At every moment the two parts at the border must not have a
        # merge that comes before the next one to be undone, else it would have crossed the border.
        before = len(self.tokens)
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < before:
                return False
            a, b = self.halves[left], self.halves[right]
            if a is None and b is None:
                return True
            # Of two equal tokens the left one is merged first, so the right one is undone first.
            if b is not None and (a is None or right >= left):
                before, right = right + 1, b[0]
            else:
                before, left = left, a[1]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        begins: list[list[int]] = [[] for _ in range(n)]
        for end, i in self.automaton.iter(piece[::-1].decode("latin-1")):
            begins[n - 1 - end].append(i)
        for at in begins:  # longest first
            at.sort(key=lambda i: -len(self.tokens[i]))
        dead = bytearray(n + 1)
        out: list[int] = []
        tried: list[int] = [0]  # at each open place, how many of its tokens were tried
        at = 0
        while at < n:
            options, k = begins[at], tried[-1]
            while k < len(options):
                i = options[k]
                k += 1
                if not dead[at + len(self.tokens[i])] and (not out or self.fits(out[-1], i)):
                    break
            else:
                # No way on with what stands before: go back and try a shorter token there.
                dead[at] = 1
                tried.pop()
                if not out:
                    raise ValueError("the vocabulary doesn't cover this text")
                at -= len(self.tokens[out.pop()])
                continue
            tried[-1] = k
            out.append(i)
            tried.append(0)
            at += len(self.tokens[i])
        return out

    def encode(self, text: str, known: dict[str, list[int]] | None = None) -> list[int]:
        """Ids of a text; strings of special tokens are ordinary text."""
        known = {} if known is None else known
        ids: list[int] = []
        for piece in self.pattern.findall(text):
            got = known.get(piece)
            if got is None:
                got = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= 64:
                    if len(known) >= 500_000:
                        known.clear()
                    known[piece] = got
            ids += got
        return ids

    @cached_property
    def _offsets(self) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter((len(t) for t in self.tokens), np.int64, len(self.tokens))
        return np.frombuffer(b"".join(self.tokens), np.uint8), np.r_[0, np.cumsum(sizes)]

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of a list of ids."""
        buffer, starts = self._offsets
        ids = np.asarray(list(ids), np.int64)
        if not len(ids):
            return b""
        sizes = starts[ids + 1] - starts[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(starts[ids], sizes)
        return buffer[at].tobytes()


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """(name, pattern) of an installed public vocabulary; `load` finds its file where it runs."""
    import public_tokenizers

    return name, public_tokenizers.PATTERN


_loaded: dict[tuple[str, str], Vocabulary] = {}


def load(path: str, pattern: str) -> Vocabulary:
    """The vocabulary, read once per process; `path` is a file or the name of a public vocabulary installed on this machine."""
    if (path, pattern) not in _loaded:
        file = path
        if not os.path.exists(file):
            import public_tokenizers

            file = public_tokenizers.path(path)
        _loaded[path, pattern] = Vocabulary(file, pattern)
    return _loaded[path, pattern]


def token_ids(text: Column, path: str, pattern: str) -> Column:
    """ARRAY<INT> of ids; empty for empty and for null text. The whole text counts, however long."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary, known = load(path, pattern), {}
        for batch in batches:
            yield pd.Series([np.asarray(vocabulary.encode(t, known), np.int32) if t else np.empty(0, np.int32) for t in batch])

    return run(text)


def token_counts(text: Column, path: str, pattern: str) -> Column:
    """BIGINT number of tokens; 0 for empty and for null text."""

    @F.pandas_udf("bigint")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary, known = load(path, pattern), {}
        for batch in batches:
            yield pd.Series([len(vocabulary.encode(t, known)) if t else 0 for t in batch], dtype="int64")

    return run(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """STRING of a list of ids; null for null, bytes that are no UTF-8 as U+FFFD."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = load(path, pattern)
        for batch in batches:
            yield pd.Series([None if x is None else vocabulary.decode(x).decode("utf-8", "replace") for x in batch])

    return run(ids)


def encode_corpus(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, ids): each row once, no shuffle and no Python beyond the encoder.

    Null and empty texts have an empty list. Repeated rows, equal ids and null ids come out as they
    stand, an empty table gives an empty result, and other columns aren't read. Without a path the
    installed public vocabulary `byte_bpe_50k` is used.
    """
    from citeloom.functions.text import pick

    if path is None or pattern is None:
        path, pattern = public_vocabulary()
    rows = pick(df, {"id": id_column, "text": text_column})
    return rows.select(F.col("id").alias(id_column), token_ids(F.col("text"), path, pattern).alias("ids"))
