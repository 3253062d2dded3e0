"""Word labels: silver (rule-derived) labels, vocabulary, encoding, per-document counts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import EMAIL_PATTERN, ID_NUM_PATTERN, full_match, match_word
from ..schema import LABEL_TO_ID, O_ID, O_LABEL, TARGET_LABELS

#: Entries of a vocabulary that travels as one value.
DICTIONARY_MAX = 10_000
#: Codes of the words of a phone span.
PHONE_CODES = {1: "B-PHONE_NUM", 2: "I-PHONE_NUM"}


def silver_labels(words: DataFrame, phone_rows: DataFrame) -> DataFrame:
    """Deterministic word labels, first rule wins: e-mail word -> B-EMAIL; word inside a
    phone span -> B-/I-PHONE_NUM; sixteen digits -> B-ID_NUM; position mod 40 = 7 / 8 ->
    B-/I-NAME_STUDENT; else O. A blank word is always O.

    ``words`` needs ``document, token, word, blank``; ``phone_rows`` is the output of
    :func:`tessera.operators.rules.detect_phones`. The join is keyed by document first, so
    it reuses the corpus layout.
    """
    ph = phone_rows.select("document", "token", F.col("label").alias("_phone"))
    j = words.join(ph, ["document", "token"], "left")
    rule = word_rules(F.col("word"), F.col("token"), F.col("blank"), [(F.col("_phone").isNotNull(), F.col("_phone"))], F.lit)
    return j.withColumn("label", rule).drop("_phone")


def word_rules(word: Column, token: Column, blank: Column, phone: list[tuple[Column, Column]],
               value: Callable[[str], Column]) -> Column:
    """The rules of :func:`silver_labels` for one word; ``phone``: tests and values of words inside a phone span,
    ``value``: how a label is written."""
    rule = F.when(blank, value(O_LABEL)).when(word.contains("@") & full_match(word, EMAIL_PATTERN), value("B-EMAIL"))
    for test, label in phone:
        rule = rule.when(test, label)
    return (rule.when((F.length(word) == 16) & full_match(word, ID_NUM_PATTERN), value("B-ID_NUM"))
            .when(token % 40 == 7, value("B-NAME_STUDENT"))
            .when(token % 40 == 8, value("I-NAME_STUDENT"))
            .otherwise(value(O_LABEL)))


def word_label_id(word: Column, token: Column, phone_code: Column, blank: Column) -> Column:
    """Silver label id of a word: 1 or 2 as ``phone_code`` if it begins or continues a phone span. Give stored columns:
    the word is read many times."""
    value = lambda label: F.lit(LABEL_TO_ID[label])
    return word_rules(word, token, blank, [(phone_code == i, value(x)) for i, x in PHONE_CODES.items()], value)


def match_label_ids(matches: Column) -> Column:
    """Label ids of a document's words from its stored array of tokeniser matches, by the rules that read a word and its place
    alone: :func:`with_phone_labels` adds blank words and phones."""
    value = lambda label: F.lit(LABEL_TO_ID[label])
    return F.transform(F.transform(matches, match_word), lambda word, i: word_rules(word, i, F.lit(False), [], value))


def with_phone_labels(ids: np.ndarray, code: np.ndarray, blank: np.ndarray) -> np.ndarray:
    """:func:`word_label_id` from :func:`match_label_ids`: a phone comes after an e-mail word and before the other rules."""
    phone = np.array([O_ID, *[LABEL_TO_ID[PHONE_CODES[i]] for i in (1, 2)]], np.int32)[code]
    return np.where(blank, O_ID, np.where((code > 0) & (ids != LABEL_TO_ID["B-EMAIL"]), phone, ids)).astype(np.int32)


def label_vocab(long_labels: DataFrame, label_col: str = "label") -> DataFrame:
    """Sorted distinct labels with dense ids from 0: ``(label_id, label)``.

    The distinct step is a partial (map-side) aggregate; only the handful of distinct
    labels reach the final single-partition numbering.
    """
    distinct = long_labels.where(F.col(label_col).isNotNull()).select(
        F.col(label_col).alias("label")).distinct()
    w = Window.orderBy("label")
    return distinct.select((F.row_number().over(w) - 1).cast("int").alias("label_id"), "label")


def dictionary(vocab: DataFrame) -> Column:
    """A vocabulary ``(label_id, label)`` as one map value, label -> id: a scalar subquery of the query that reads it.

    A vocabulary is small by nature (a label set, a class column); one of more than ``DICTIONARY_MAX``
    entries raises, and :func:`join_encode` is there for it.
    """
    entries = F.collect_list(F.struct("label", "label_id"))
    many = F.raise_error(F.concat(F.lit("vocabulary too large for a dictionary: "), F.count(F.lit(1)).cast("string")))
    whole = F.when(F.count(F.lit(1)) <= DICTIONARY_MAX, F.map_from_entries(entries)).otherwise(many)
    return vocab.where(F.col("label").isNotNull()).agg(whole.alias("codes")).scalar()


def label_encode(long_labels: DataFrame, vocab: DataFrame, label_col: str = "label") -> DataFrame:
    """Attach ``label_id``; a label missing from the vocabulary raises at run time.

    Codes come from a :func:`dictionary`, so rows stay where they are: no join and no shuffle by
    label, however hot a label such as ``O`` is.
    """
    label = F.col(label_col)
    code = F.try_element_at(dictionary(vocab), label)
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), label))
    return long_labels.withColumn("label_id", F.when(label.isNull(), F.lit(None)).otherwise(F.coalesce(code, unknown)).cast("int"))


def class_encode(df: DataFrame, column: str) -> DataFrame:
    """Dictionary-encode a column: dense ids over its sorted distinct values, as ``<column>_code``; null stays null."""
    codes = dictionary(label_vocab(df, column))
    return df.withColumn(f"{column}_code", F.when(F.col(column).isNotNull(), F.try_element_at(codes, F.col(column))))


def join_encode(df: DataFrame, column: str) -> DataFrame:
    """:func:`class_encode` for a column of any number of values: by a join on the value."""
    codes = label_vocab(df, column).select(F.col("label").alias(column), F.col("label_id").alias(f"{column}_code"))
    return df.join(codes, column, "left")


def is_target(label) -> F.Column:
    return label.isin(*TARGET_LABELS)


def doc_target_counts(word_labels: DataFrame) -> DataFrame:
    """Per document: ``target_num`` = words with a target label, ``group`` = target_num > 0."""
    return word_labels.groupBy("document").agg(
        F.count(F.lit(1)).cast("int").alias("n_words"),
        F.sum(F.when(is_target(F.col("label")), 1).otherwise(0)).cast("int").alias("target_num"),
    ).withColumn("group", F.when(F.col("target_num") > 0, 1).otherwise(0))
