"""Corpus <-> word rows: tokenising, exploding, character spans, detokenising.

Layout rule of the library: the corpus is hash-partitioned on ``document`` once
(:func:`layout_by_document`); every later per-document window, aggregate and join runs on
that partitioning without another exchange. One document is one input row, so the largest
group any of them sees is bounded by a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detokenize, is_blank, match_has_space, match_word, word_matches


def layout_by_document(df: DataFrame) -> DataFrame:
    """Hash-partition rows on ``document`` (the one shuffle of the raw corpus).

    Without a partition number, so adaptive execution sizes the partitions.
    """
    return df.repartition("document")


def tokenize_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents -> corpus rows ``(document, full_text, tokens, trailing_whitespace)``.

    Lossless: ``detokenize(tokens, trailing_whitespace) == full_text``. All in-row.
    """
    m = word_matches(F.col(text_col))
    return docs.select(
        "document",
        F.col(text_col).alias("full_text"),
        m.alias("_matches"),
    ).select(
        "document",
        "full_text",
        F.transform("_matches", match_word).alias("tokens"),
        F.transform("_matches", match_has_space).alias("trailing_whitespace"),
    )


def document_words(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Word rows straight from text: ``(document, token, word, trailing_whitespace, n_words)``.

    One ``posexplode`` of the tokeniser matches; nothing is recomputed per element.
    """
    # The match array is computed once per document, below the explode; the plain generator would have it computed
    # again, to ask whether it is empty.
    arrays = docs.select("document", *keep, word_matches(F.col(text_col)).alias("_ms"))
    exploded = arrays.select(
        "document", *keep,
        F.size("_ms").alias("n_words"),
        F.posexplode_outer("_ms").alias("token", "_m"),
    ).where(F.col("token").isNotNull())
    return exploded.select(
        "document",
        F.col("token").cast("int").alias("token"),
        match_word(F.col("_m")).alias("word"),
        match_has_space(F.col("_m")).alias("trailing_whitespace"),
        F.col("n_words").cast("int").alias("n_words"),
        *keep,
    )


def corpus_words(corpus: DataFrame, with_labels: bool = False) -> DataFrame:
    """Word rows from a corpus with token arrays (a loaded JSON corpus, say)."""
    sources = ["tokens", "trailing_whitespace"]
    names = ["word", "trailing_whitespace"]
    if with_labels:
        sources.append("provided_labels")
        names.append("label")
    z = F.arrays_zip(*[F.col(c) for c in sources])
    exploded = corpus.select("document", F.size("tokens").alias("n_words"),
                             F.posexplode(z).alias("token", "_z"))
    return exploded.select(
        "document",
        F.col("token").cast("int").alias("token"),
        *[F.col("_z").getField(src).alias(n) for src, n in zip(sources, names)],
        F.col("n_words").cast("int").alias("n_words"),
    )


def with_char_spans(words: DataFrame) -> DataFrame:
    """Add ``char_start, char_end`` (word span ``[start, end)`` in the detokenised text),
    ``blank`` (word is whitespace) and ``prev_space`` (the character before the word is
    whitespace). One running-sum window per document, ordered by position.
    """
    w = Window.partitionBy("document").orderBy("token")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mlen = F.length("word") + F.when(F.col("trailing_whitespace"), 1).otherwise(0)
    blank = is_blank(F.col("word"))
    return (
        words.withColumn("blank", blank)
        .withColumn("_mlen", mlen)
        .withColumn("_end", F.sum("_mlen").over(running))
        .withColumn(
            "prev_space",
            F.coalesce(F.lag("trailing_whitespace").over(w) | F.lag("blank").over(w), F.lit(False)),
        )
        .withColumn("char_start", (F.col("_end") - F.col("_mlen")).cast("int"))
        .withColumn("char_end", (F.col("char_start") + F.length("word")).cast("int"))
        .drop("_mlen", "_end")
    )


def token_explode(corpus: DataFrame) -> DataFrame:
    """The long token table ``(document, token_value, label, token)``.

    Tokens and labels explode in lock-step; their sizes must agree (checked: a mismatch
    raises at run time). An empty document keeps one row with null value and label.
    """
    checked = corpus.withColumn(
        "_ok",
        F.when(F.size("tokens") == F.size("provided_labels"), F.lit(True)).otherwise(
            F.raise_error(F.lit("tokens and labels differ in length"))
        ),
    )
    z = F.arrays_zip(F.col("tokens"), F.col("provided_labels"))
    exploded = checked.where("_ok").select("document", F.posexplode_outer(z).alias("_pos", "_z"))
    return exploded.select(
        "document",
        F.col("_z").getField("tokens").alias("token_value"),
        F.col("_z").getField("provided_labels").alias("label"),
        F.coalesce(F.col("_pos"), F.lit(0)).cast("int").alias("token"),
    )


def detokenized(corpus: DataFrame) -> DataFrame:
    return corpus.select(
        "document", detokenize(F.col("tokens"), F.col("trailing_whitespace")).alias("text")
    )
