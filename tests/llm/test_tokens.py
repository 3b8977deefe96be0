import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from medloom.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.vocabulary_path()), reason="no vocabulary")


@pytest.fixture(scope="module")
def pairs():
    with open(tokens.vocabulary_path(), "rb") as file:
        return tokens.BytePairs(file.read())


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    return made


SAMPLES = ["", " ", "  ", "a", " a  b\n\n c", "L'été d'août n'est pas\tfini…", "😀 漢字 ١٢٣", "<|endoftext|>", "I'll we've\r\n\r\n x", "é" * 300, "a\x00\x1fb", "\n \nb", "x \n y", "ab " * 500]


@pytest.mark.parametrize("text", SAMPLES)
def test_like_the_public_library(pairs, theirs, text):
    assert pairs.encode(text) == theirs.encode(text, add_special_tokens=False).ids
    assert pairs.decode(pairs.encode(text)) == text and pairs.count(text) == len(pairs.encode(text))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"aBé1 .,'\n\t’漢", "  ", "'s", "ll", "the"]), max_size=40).map("".join))
def test_any_text(pairs, theirs, text):
    assert pairs.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing(theirs, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 2)
    with open(tokens.vocabulary_path(), "rb") as file:
        small = tokens.BytePairs(file.read())
    text = "one two three two one four"
    assert small.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_tables(spark, pairs):
    df = spark.createDataFrame([(1, "some text", "x"), (2, None, None), (3, "", "y"), (4, "  ", None), (5, "some text", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode_texts(df).collect()}
    assert got == {1: pairs.encode("some text"), 2: [], 3: [], 4: pairs.encode("  "), 5: pairs.encode("some text")}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()} == {k: len(v) for k, v in got.items()}
    back = {r.doc_id: r.text for r in tokens.decode_ids(tokens.encode_texts(df)).collect()}
    assert back == {1: "some text", 2: "", 3: "", 4: "  ", 5: "some text"}
    assert tokens.encode_texts(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "wordy " * 50_000)], "doc_id long, text string")
    assert tokens.count_tokens(long).first().n_tokens == pairs.count("wordy " * 50_000)
