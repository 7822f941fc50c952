import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import docs, with_clashes
from tidewright.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPEC = open(PATH, encoding="utf-8").read()
TOK = Tokenizer.from_str(SPEC)
WHOLE = tokens.prove_whole_tokens(SPEC)
COUNT = tokens._counter(SPEC, WHOLE, tokens._checked(SPEC))


def library(text):
    return len(TOK.encode(text or "", add_special_tokens=False).ids)


def test_every_proved_string_is_one_token():
    assert len(WHOLE) > 40_000
    sample = random.Random(1).sample(WHOLE, 3000)
    assert all(library(s) == 1 for s in sample)


def test_specials_spaces_and_scripts():
    texts = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> x", "<|endof", "  a   b\n\n\tc  ", "don't we'll I'M", "é漢字🙂 ٣Ⅷ½", "a\x1cb\x85c\xa0d", "​﻿", "x" * 5000]
    assert COUNT(texts) == [library(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"aB 1\n\t'sé²ß漢🙂\xa0\x85\x1c!$", "<|endoftext|>", "'ll", "  "]), max_size=30).map("".join))
def test_equals_the_library(text):
    assert COUNT([text]) == [library(text)]


def test_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 50)
    text = "Hello there, 12 monkeys!  \n" * 200 + "漢字 end"
    assert COUNT([text, None, text]) == [library(text), 0, library(text)]


def test_table_cases(spark):
    df = with_clashes(docs(spark, ["the cat", None, "", "the cat", "x " * 20000]))
    got = tokens.count_tokens(df, PATH, out="n_tokens").select("doc_id", "n_tokens", "mark").orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == [2, 0, 0, 2, library("x " * 20000)]
    assert got[0]["mark"] == "own mark"
    replaced = tokens.count_tokens(df, PATH, out="score").where("doc_id = 0").first()
    assert replaced["score"] == 2
    assert tokens.count_tokens(df.limit(0), PATH).count() == 0


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        tokens._checked(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_query_equals_the_library(spark, sf):
    from tidewright.llm.queries import op1_token_counts

    got = {r["doc_id"]: r for r in op1_token_counts(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["n_tokens"], g["over_limit"]) == (len((r["text"] or "").encode()), library(r["text"]), library(r["text"]) > 1024)
