import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from feedloom.llm import tokens

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
PAIRS = {}


def pair(name):
    if name not in PAIRS:
        path = public_tokenizers.path(name)
        PAIRS[name] = tokens.Encoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    return PAIRS[name]


@pytest.mark.parametrize("name", FILES)
def test_words_are_cut_as_by_the_library(name):
    assert pair(name)[0].word is not None


@pytest.mark.parametrize("name", FILES)
@given(st.text(st.one_of(st.characters(max_codepoint=0x24F), st.sampled_from(" \n'strevmld.,“é東١²½́İß<|>"))))
@settings(max_examples=400, deadline=None)
def test_any_text_is_encoded_as_by_the_library(name, text):
    mine, library = pair(name)
    assert mine(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_documents_are_encoded_as_by_the_library(spark, name):
    from conftest import SF_DIR

    texts = [r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()]
    texts += ["it's we'll 'S <|endoftext|> x", "a" * 5000, " \n\n x  y\t", "\x1c\x85\xa0 q"]
    mine, library = pair(name)
    for text in texts:
        assert np.array_equal(mine(text), library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("name", FILES)
def test_a_text_is_cut_in_one_pass(name, monkeypatch):
    mine, library = pair(name)
    cut, calls = mine.word, []
    monkeypatch.setattr(mine, "word", lambda text: calls.append(text) or cut(text))
    text = "One, two! It's three;\nfour (five) 66 seven."
    assert mine(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(calls) == 1
