"""Sub-word pieces: cutting words into pieces, aligning pieces back to words, piece labels.

A piece table is ``(document, piece, start, end)`` with character offsets into the
detokenised text; ``(0, 0)`` marks a special piece (sequence head / tail).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def _empty_ints():
    return F.array().cast("array<int>")


def cut_pieces(words: DataFrame, piece_len: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cut every non-blank word into runs of ``piece_len`` characters, numbered in document
    order from 1; piece 0 (head) and the last piece (tail) are specials ``(0, 0)``.

    The first piece of a word starts one character early when the character before the
    word is whitespace. ``words`` needs ``document, token, n_words, blank, prev_space,
    char_start, char_end``. Output ``(document, piece, token, start, end, *carry)`` where
    ``token`` is the word a piece was cut from (-1 for specials).
    """
    n_pieces = F.when(F.col("blank"), F.lit(0)).otherwise(
        F.ceil(F.length("word") / F.lit(piece_len))).cast("int")
    running = Window.partitionBy("document").orderBy("token").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    x = words.withColumn("_k", n_pieces).withColumn("_cum", F.sum("_k").over(running))
    js = F.concat(
        F.when(F.col("token") == 0, F.array(F.lit(-1))).otherwise(_empty_ints()),
        F.when(F.col("_k") > 0, F.sequence(F.lit(0), F.col("_k") - 1)).otherwise(_empty_ints()),
        F.when(F.col("token") == F.col("n_words") - 1, F.array(F.col("_k"))).otherwise(_empty_ints()),
    )
    # A stored column, as an expression given to a generator is interpreted for every row; and the outer generator, as
    # for the plain one a test that the array isn't empty is put below the column, which computes it twice.
    x = x.select("document", "token", "char_start", "char_end", "prev_space", "_k", "_cum", *carry, js.alias("_js"))
    exploded = x.select("document", "token", "char_start", "char_end", "prev_space", "_k", "_cum",
                        *carry, F.explode_outer("_js").alias("_j")).where(F.col("_j").isNotNull())
    j = F.col("_j")
    special = (j == -1) | (j == F.col("_k"))
    begin = F.col("char_start") + F.lit(piece_len) * j
    shift = F.when((j == 0) & F.col("prev_space"), 1).otherwise(0)
    return exploded.select(
        "document",
        (F.col("_cum") - F.col("_k") + j + 1).cast("int").alias("piece"),
        F.when(special, F.lit(-1)).otherwise(F.col("token")).cast("int").alias("token"),
        F.when(special, F.lit(0)).otherwise(begin - shift).cast("int").alias("start"),
        F.when(special, F.lit(0)).otherwise(
            F.least(begin + F.lit(piece_len), F.col("char_end"))).cast("int").alias("end"),
        *[F.when(special, F.lit(None)).otherwise(F.col(c)).alias(c) for c in carry],
    )


def align_pieces(pieces: DataFrame, words: DataFrame, carry: tuple[str, ...] = (),
                 with_token_str: bool = True) -> DataFrame:
    """Map every non-special piece to the word it belongs to.

    Rule: a piece starting on a separator moves one character right, then over blank words;
    the result is the first non-blank word whose ``char_end`` exceeds the piece start. No
    such word -> the piece is dropped. Special pieces (``start + end = 0``) are dropped.

    Done as an as-of lookup, not a range join: piece starts and word ends are unioned and
    one descending running ``last(..., ignorenulls)`` per document hands each piece the
    nearest word end above it. Linear after the sort, whatever the document length.
    Output ``(document, piece, token[, token_str], start, end, *carry)``.
    """
    payload = F.struct("piece", "start", "end", *carry)
    word_fields = [F.col("token").cast("int").alias("token")]
    if with_token_str:
        word_fields.append(F.col("word").alias("token_str"))
    ev_words = words.where(~F.col("blank")).select(
        "document",
        F.col("char_end").alias("_pos"),
        F.lit(1).alias("_kind"),
        F.struct(*word_fields).alias("_w"),
    )
    ev_pieces = pieces.where(F.col("start") + F.col("end") > 0).select(
        "document",
        F.col("start").alias("_pos"),
        F.lit(0).alias("_kind"),
        F.lit(None).cast(ev_words.schema["_w"].dataType).alias("_w"),
        payload.alias("_p"),
    )
    ev_words = ev_words.withColumn("_p", F.lit(None).cast(ev_pieces.schema["_p"].dataType))
    w = Window.partitionBy("document").orderBy(F.col("_pos").desc(), F.col("_kind").asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = ev_words.unionByName(ev_pieces).withColumn("_hit", F.last("_w", ignorenulls=True).over(w))
    return found.where((F.col("_kind") == 0) & F.col("_hit").isNotNull()).select(
        "document", F.col("_p.piece").alias("piece"),
        F.col("_hit.token").alias("token"),
        *([F.col("_hit.token_str").alias("token_str")] if with_token_str else []),
        F.col("_p.start").alias("start"), F.col("_p.end").alias("end"),
        *[F.col(f"_p.{c}").alias(c) for c in carry],
    )


def labelled_pieces(pieces: DataFrame, word_labels: DataFrame) -> DataFrame:
    """Training label of every piece: special -> O; a piece starting on whitespace moves one
    character right; then the label of the word holding that character (a separator -> O).

    ``word_labels``: ``document, token, word, blank, trailing_whitespace, char_start,
    char_end, label``. As-of lookup of the last word starting at or before the piece start; specials
    pass through it, so the result keeps the layout by document. Output ``(document, piece,
    start, end, label)``.
    """
    nxt = Window.partitionBy("document").orderBy("token")
    wl = word_labels.withColumn("_next_label", F.lead("label").over(nxt))
    ev_words = wl.select(
        "document",
        F.col("char_start").alias("_pos"),
        F.lit(0).alias("_kind"),
        F.struct("char_end", "blank", "trailing_whitespace", "label", "_next_label").alias("_w"),
        F.lit(None).cast("int").alias("piece"), F.lit(None).cast("int").alias("end"),
    )
    ev_pieces = pieces.select(
        "document", F.col("start").alias("_pos"), F.lit(1).alias("_kind"),
        F.lit(None).cast(ev_words.schema["_w"].dataType).alias("_w"),
        "piece", "end",
    )
    w = Window.partitionBy("document").orderBy(F.col("_pos").asc(), F.col("_kind").asc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    found = ev_words.unionByName(ev_pieces).withColumn("_hit", F.last("_w", ignorenulls=True).over(w))
    s = F.col("_pos")
    hit = F.col("_hit")
    inside = s < hit["char_end"]
    label = (
        F.when(s + F.col("end") == 0, F.lit("O"))
        .when(inside & ~hit["blank"], hit["label"])
        # Piece starts in a blank word: one step right stays in it, or leaves it.
        .when(inside & (s + 1 < hit["char_end"]), hit["label"])
        .when(inside & hit["trailing_whitespace"], F.lit("O"))
        .when(inside, F.coalesce(hit["_next_label"], F.lit("O")))
        # Piece starts on the separator after a word: one step right is the next word.
        .otherwise(F.coalesce(hit["_next_label"], F.lit("O")))
    )
    return found.where(F.col("_kind") == 1).select("document", "piece", s.alias("start"), "end", label.alias("label"))


def piece_labels(pieces: DataFrame, word_labels: DataFrame) -> DataFrame:
    """``(document, piece, label)`` of :func:`labelled_pieces`."""
    return labelled_pieces(pieces, word_labels).select("document", "piece", "label")


def truncate_right(pieces: DataFrame, max_length: int) -> DataFrame:
    """Keep the first ``max_length`` positions of each piece sequence (head and tail
    specials included, as a tokenizer with truncation does): real pieces up to
    ``max_length - 2`` and the tail renumbered to ``max_length - 1`` when cut.
    """
    keep = (F.col("piece") <= max_length - 2) | (F.col("start") + F.col("end") == 0)
    return pieces.where(keep).withColumn(
        "piece",
        F.when(F.col("piece") > max_length - 2, F.lit(max_length - 1)).otherwise(F.col("piece")).cast("int"),
    )
