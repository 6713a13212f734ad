import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillstone.llm import encode
from rillstone.llm.encode import Encoder



@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


PIECES = ["a", "é", "日", "1", "٣", " ", "  ", "\n", "\t", "'s", "'", "'ll", "!", "。", "-", "́", "\x1c", "\x85", "᠎", "​", "﻿", "　", "😀", "<|endoftext|>", "\r\n", "क्ष", "ß", "²", "\xa0", "don't", " The"]


def test_any_tree_gives_the_ids_of_the_whole_text(reference):
    rng = random.Random(1)
    for leaf, window in ((1, 1), (3, 1), (7, 2), (8192, 32)):
        e = Encoder(leaf=leaf, window=window)
        for _ in range(1500):
            text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 30)))
            assert e.encode(text) == reference(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_round_trip_of_any_text(text):
    e = Encoder(leaf=4, window=1)
    ids = e.encode(text)
    assert e.decode(ids) == text and ids == Encoder().encode(text)


def test_joining_is_associative_with_the_empty_text():
    e = Encoder(leaf=4, window=1)
    text = "we'll see  12,000 日本語。 it's'll\n\n  end"
    whole = e.bpe.encode_ordinary(text)
    for i in range(len(text) + 1):
        l, r = e.bpe.encode_ordinary(text[:i]), e.bpe.encode_ordinary(text[i:])
        assert e.join(text, 0, i, len(text), l, r) == whole


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 100_000, "\n a" * 30_000, "日" * 50_000, "'" * 50_000, " " * 60_000 + "x", "word " * 100_000], ids=["a", "blank", "mixed", "cjk", "quote", "indent", "words"])
def test_very_long_texts(text, reference):
    e = Encoder()
    ids = e.encode(text)
    assert ids == reference(text) and e.decode(ids) == text


def test_corpus_with_nulls_repeats_and_extra_columns(spark, rows):
    docs = spark.createDataFrame([(1, "hello world", "x"), (1, "hello world", "x"), (2, None, None), (3, "", "y"), (None, "<|endoftext|>", "z")], "doc_id bigint, text string, ids string")
    got = rows(encode.encode_corpus(docs))
    e = Encoder()
    assert got == sorted([(1, e.encode("hello world"))] * 2 + [(2, []), (3, []), (None, e.encode("<|endoftext|>"))], key=repr) and 50256 not in got[-1][1]
    assert encode.encode_corpus(docs).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert encode.encode_corpus(docs.filter("false")).count() == 0
    n = rows(encode.count_tokens(docs.withColumn("n_tokens", F.lit(0)), ["doc_id"]))
    assert n == sorted(((i, len(x)) for i, x in got), key=repr)


def test_other_vocabulary(spark):
    docs = spark.createDataFrame([(1, "größer")], "doc_id bigint, text string")
    a = encode.encode_corpus(docs, vocabulary="byte_bpe_multi_50k").first().ids
    assert Encoder("byte_bpe_multi_50k").decode(a) == "größer" and a != Encoder().encode("größer")
