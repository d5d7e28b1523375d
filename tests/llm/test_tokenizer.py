import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citeloom.llm.tokenizer import decoded, encode_corpus, load, public_vocabulary, token_counts


@pytest.fixture(scope="module")
def both():
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    return load(*public_vocabulary()), other


def same(both, text):
    mine, other = both
    ids = mine.encode(text)
    assert ids == other.encode(text, add_special_tokens=False).ids
    assert mine.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "a", "<|endoftext|>", "  a\n\n b\t", "naïve café ﬁ 文本 🔬", "it's we'll 12345", "a" * 30_000, "ab" * 9_000, " " * 5_000, "aaab" * 5_000, "\x00́"])
def test_same_as_the_library(both, text):
    same(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    same(both, text)


def test_words_made_of_tokens(both):
    # Pieces of tokens side by side force the encoder to go back.
    rng = random.Random(4)
    tokens = [t for t in both[0].tokens if t.isalpha()]
    for _ in range(2000):
        same(both, "".join((t[: rng.randint(1, len(t))]).decode() for t in rng.choices(tokens, k=rng.randint(2, 6))))


def test_all_tokens_give_themselves(both):
    mine = both[0]
    assert all(mine.encode_piece(t) == [i] for i, t in enumerate(mine.tokens))


def test_corpus(spark, sf, both):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a b", 0), (None, "x" * 200_000, 0)], "doc_id long, text string, ids int")
    rows = encode_corpus(df).collect()
    want = both[1].encode("a b").ids
    assert sorted((r.doc_id or 0, len(r.ids)) for r in rows)[1:] == [(1, 0), (2, 0), (3, len(want)), (3, len(want))]
    assert [r.ids for r in rows if r.doc_id == 3] == [want, want]
    assert encode_corpus(df.limit(0)).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    back = encode_corpus(docs).join(docs, "doc_id").select("text", "ids", decoded(F.col("ids"), *public_vocabulary()).alias("back"), token_counts(F.col("text"), *public_vocabulary()).alias("n"))
    for r in back.collect():
        assert r.back == (r.text or "") and r.n == len(r.ids)
        assert r.ids == (both[1].encode(r.text, add_special_tokens=False).ids if r.text else [])
