import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import docs_df
from tessera.operators.tokens import (document_words, detokenized, token_explode, tokenize_documents,
                                      with_char_spans)

ALPHABET = "ab1.@+- \n\t é_,(x"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=30))
def test_detokenize_is_lossless(spark, texts):
    corpus = tokenize_documents(docs_df(spark, texts))
    back = {r.document: r.text for r in detokenized(corpus).collect()}
    assert [back[i] for i in range(len(texts))] == texts


def test_char_spans_cover_text(spark):
    text = "Hi  there\nbob@x.io (555) 123-4567 end"
    rows = with_char_spans(document_words(docs_df(spark, [text]))).orderBy("token").collect()
    for r in rows:
        assert text[r.char_start:r.char_end] == r.word
    assert [r.word for r in rows if not r.blank][:2] == ["Hi", "there"]


def test_nbsp_word_is_blank(spark):
    rows = with_char_spans(document_words(docs_df(spark, ["a   b"]))).orderBy("token").collect()
    blank = {r.word: r.blank for r in rows}
    assert blank[" "] is True and blank["a"] is False


def test_empty_document_keeps_one_null_row(spark):
    corpus = spark.createDataFrame([(7, "", [], [], [])],
                                   "document long, full_text string, tokens array<string>, "
                                   "trailing_whitespace array<boolean>, provided_labels array<string>")
    rows = token_explode(corpus).collect()
    assert len(rows) == 1 and rows[0].token_value is None and rows[0].token == 0


def test_unequal_arrays_raise(spark):
    corpus = spark.createDataFrame([(1, "a b c", ["a", "b", "c"], [True, True, False], ["O", "O"])],
                                   "document long, full_text string, tokens array<string>, "
                                   "trailing_whitespace array<boolean>, provided_labels array<string>")
    with pytest.raises(Exception):
        token_explode(corpus).collect()


def test_words_keep_positions(spark):
    w = document_words(docs_df(spark, ["x y"])).orderBy("token").select("token", "word", "n_words").collect()
    assert [(r.token, r.word, r.n_words) for r in w] == [(0, "x", 2), (1, "y", 2)]
