"""Training-set preparation on word rows: cuts, id shifts, doubling, positive filter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bio import label_id
from ..schema import (INNER_FOLD, INNER_FOLDS, INNER_SEED, OUTER_FOLD, OUTER_FOLDS, OUTER_SEED, TRAIN_MAX_PIECES,
                      TRUNCATE_LEFT_WORDS)
from .in_row import document_counts, document_examples, planned_documents
from .labels import doc_target_counts, is_target
from .pieces import cut_pieces, labelled_pieces, truncate_right
from .splits import BUCKET_HEX, chained_offsets, fold_of, positions, range_bucket, shuffle_key, unique_documents
from .tokens import with_char_spans


def truncate_left(word_rows: DataFrame, keep_last: int = TRUNCATE_LEFT_WORDS) -> DataFrame:
    """Keep the last ``keep_last`` words of every document, renumbered from 0.

    ``word_rows`` needs ``document, token, n_words``; ``n_words`` becomes the kept count.
    Row-local: no window, no shuffle. Documents in one row (:func:`tessera.operators.in_row.piece_rows`) keep their words, as a
    label may hang on words that are cut, and get their number to leave out, ``_skip``.
    """
    if "_ms" in word_rows.columns:
        return word_rows.withColumn("_skip", F.greatest(F.size("_ms") - F.lit(keep_last), F.lit(0)))
    skip = F.greatest(F.col("n_words") - F.lit(keep_last), F.lit(0))
    return word_rows.where(F.col("token") >= skip).withColumn(
        "token", (F.col("token") - skip).cast("int")).withColumn(
        "n_words", F.least(F.col("n_words"), F.lit(keep_last)).cast("int"))


def document_shift(df: DataFrame, offset: int | Column) -> DataFrame:
    """Add a constant to document ids (the second copy of a training set)."""
    off = offset if isinstance(offset, Column) else F.lit(int(offset))
    return df.withColumn("document", (F.col("document") + off).cast("long"))


def double_truncate(word_rows: DataFrame, offset: int | Column,
                    keep_last: int | None = TRUNCATE_LEFT_WORDS, double: bool = True) -> DataFrame:
    """The base set twice: uncut (``copy = 'full'``) and left-cut with ids shifted by
    ``offset`` (``copy = 'cut'``). ``double=False`` keeps only the cut copy; no cut length
    keeps only the uncut copy; doubling without a cut length is an error."""
    if double and keep_last is None:
        raise ValueError("doubling the base set needs a cut length")
    full = word_rows.withColumn("copy", F.lit("full"))
    if keep_last is None:
        return full
    cut = document_shift(truncate_left(word_rows, keep_last), offset).withColumn("copy", F.lit("cut"))
    return full.unionByName(cut) if double else cut


def filter_positive_docs(word_rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per-document counts of documents with at least one target word (``group = 1``)."""
    return doc_counts_by(word_rows, keys).where(F.col("group") == 1)


def positive_rows(word_rows: DataFrame) -> DataFrame:
    """The word rows of documents with at least one target word, all columns kept.

    One window per document over the layout by document: no aggregate, no join, no shuffle of its own.
    """
    has = F.max(is_target(F.col("label"))).over(Window.partitionBy("document"))
    return word_rows.withColumn("_positive", has).where("_positive").drop("_positive")


def doc_counts_by(word_rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return word_rows.groupBy(*keys, "document").agg(
        F.count(F.lit(1)).cast("int").alias("n_words"),
        F.sum(F.when(is_target(F.col("label")), 1).otherwise(0)).cast("int").alias("target_num"),
    ).withColumn("group", F.when(F.col("target_num") > 0, 1).otherwise(0))


def training_examples(word_rows: DataFrame, max_length: int = TRAIN_MAX_PIECES) -> DataFrame:
    """One training example per document: ``(document, pieces[], length, target_num, group)``.

    ``word_rows``: ``document, token, word, trailing_whitespace, n_words, label``, already cut on
    the left if wanted. Character spans start anew at the first word given. ``pieces`` holds
    ``(piece, start, end, label_id)`` in order, specials as ``O``, at most ``max_length`` of them;
    ``length`` is their number. ``target_num`` counts the target words before the right cut. Documents in one row
    are made examples inside it, without a shuffle, sort or join.
    """
    if "_ms" in word_rows.columns:
        return document_examples(word_rows, max_length)
    each = example_pieces(word_rows, max_length)
    counts = doc_target_counts(word_rows).select("document", "target_num", "group")
    return each.join(counts, "document").select(
        "document", "pieces", F.size("pieces").alias("length"), "target_num", "group")


def example_pieces(word_rows: DataFrame, max_length: int = TRAIN_MAX_PIECES) -> DataFrame:
    """``(document, pieces[])`` of :func:`training_examples`: at most ``max_length`` pieces a document."""
    words = with_char_spans(word_rows.select("document", "token", "word", "trailing_whitespace", "n_words", "label"))
    pieces = labelled_pieces(truncate_right(cut_pieces(words), max_length), words)
    return pieces.groupBy("document").agg(F.array_sort(F.collect_list(F.struct(
        "piece", "start", "end", label_id(F.col("label")).alias("label_id")))).alias("pieces"))


@dataclass(frozen=True)
class TrainingSet:
    """What goes into a training set.

    Corpus 0 is the base; ``extras`` are the corpora added to it. All corpora are loaded one after
    another, so the ids of each follow from those before it, added or not; ``heads`` names the corpora of
    which only the leading 1/n is loaded. The base is split twice (``outer`` test fold, ``inner``
    validation fold: number of folds, fold, seed). Its training part is taken uncut, or cut to its last
    ``keep_last`` words, or both (``double``), and without documents that hold no target word if
    ``positives_only``. Validation documents and extras are cut. ``seed`` is that of the final shuffle.
    """

    extras: tuple[int, ...] = (1,)
    heads: tuple[tuple[int, int], ...] = ((3, 10),)
    keep_last: int | None = TRUNCATE_LEFT_WORDS
    double: bool = True
    positives_only: bool = True
    max_length: int = TRAIN_MAX_PIECES
    outer: tuple[int, int, int] = (OUTER_FOLDS, OUTER_FOLD, OUTER_SEED)
    inner: tuple[int, int, int] = (INNER_FOLDS, INNER_FOLD, INNER_SEED)
    seed: int = INNER_SEED

    def __post_init__(self) -> None:
        if self.double and self.keep_last is None:
            raise ValueError("doubling the base set needs a cut length")
        if 0 in self.extras:
            raise ValueError("corpus 0 is the base, not an extra")
        for folds, fold, _ in (self.outer, self.inner):
            if not 0 <= fold < folds:
                raise ValueError(f"fold must be in [0, {folds})")


def loaded_ids(members: DataFrame, settings: TrainingSet) -> DataFrame:
    """``(corpus, source_document, document, fold, next_id)`` of every loaded document of ``members(corpus, document)``.

    One ranking pass serves all corpora: the base by the seeded key of its outer fold, the others by
    id, which gives both their leading part and their new ids. ``fold`` is null outside the base,
    ``next_id`` the id after the last corpus. Ids of a corpus must be unique (checked when the query runs).
    """
    ids = unique_documents(members, ("corpus",))
    folds, _, seed = settings.outer
    base, old = F.col("corpus") == 0, F.col("document")
    seeded = shuffle_key(seed)
    key = F.when(base, seeded).otherwise(F.lit(""))
    bucket = F.when(base, F.conv(F.substring(seeded, 1, BUCKET_HEX), 16, 10).cast("long")).otherwise(range_bucket(members, old))
    ranked = positions(ids, key, bucket, group_cols=("corpus",))
    denominator = F.lit(1)
    for corpus, n in settings.heads:
        denominator = F.when(F.col("corpus") == corpus, F.lit(n)).otherwise(denominator)
    stats = members.groupBy("corpus").agg(F.floor(F.count(F.lit(1)) / denominator).alias("n"), F.max("document").alias("max_id"))
    # One row per corpus.
    chained = chained_offsets(stats).where("n > 0")
    offsets = chained.select("corpus", F.col("n").alias("_loaded"), "offset",
                             F.max("next_offset").over(Window.partitionBy()).alias("next_id"))
    return ranked.join(offsets, "corpus").where(F.col("position") < F.col("_loaded")).select(
        "corpus", old.alias("source_document"),
        F.when(base, old).otherwise(F.col("offset") + F.col("position")).cast("long").alias("document"),
        F.when(base, fold_of(F.col("position"), F.col("n"), folds)).alias("fold"), "next_id")


def training_plan(members: DataFrame, counts: DataFrame, settings: TrainingSet = TrainingSet(),
                  keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Which documents a training set holds, under which id and at which place: a slim table.

    ``members``: ``(corpus, document)`` of all corpora; ``counts``: ``(document, n_words, targets, cut_targets)``, words
    and target words of a document, in all and among its last ``keep_last`` words. Output ``(split, origin,
    source_document, document, cut, position, n_words, target_num, group)``: ``split`` is ``train`` or ``val``,
    ``origin`` is ``base_full``, ``base_cut``, ``val`` or ``extra``; ``position`` is the place in the seeded shuffle of its
    split. Every decision is made here, on one row per document, before any word or piece is
    touched. ``keep`` may hold a table that is read more than once (a cache).
    """
    loaded = keep(loaded_ids(members, settings))
    _, test, _ = settings.outer
    folds, val, seed = settings.inner
    rest = loaded.where((F.col("corpus") == 0) & (F.col("fold") != test))
    key = shuffle_key(seed)
    inner = positions(rest.select("document", "source_document", "next_id"), key, F.substring(key, 1, BUCKET_HEX))
    is_val = fold_of(F.col("position"), F.col("n"), folds) == val
    full, cut = F.struct(F.lit("base_full").alias("origin"), F.lit(False).alias("cut")), F.struct(
        F.lit("base_cut").alias("origin"), F.lit(True).alias("cut"))
    copies = [full] if settings.keep_last is None else [full, cut] if settings.double else [cut]
    only_cut = F.lit(settings.keep_last is not None)
    val_copy = F.array(F.struct(F.lit("val").alias("origin"), only_cut.alias("cut")))
    base = inner.select("source_document", "document", "next_id", F.inline(F.when(is_val, val_copy).otherwise(F.array(*copies))))
    shifted = F.when(F.col("origin") == "base_cut", F.col("document") + F.col("next_id")).otherwise(F.col("document"))
    base = base.withColumn("document", shifted).drop("next_id")
    extra = loaded.where(F.col("corpus").isin(*settings.extras)).select(
        "source_document", "document", F.lit("extra").alias("origin"), only_cut.alias("cut"))
    sized = base.unionByName(extra).join(counts.withColumnRenamed("document", "source_document"), "source_document", "left")
    words = F.coalesce("n_words", F.lit(0))
    last = words if settings.keep_last is None else F.least(words, F.lit(settings.keep_last))
    targets = F.coalesce(F.when(F.col("cut"), F.col("cut_targets")).otherwise(F.col("targets")), F.lit(0)).cast("int")
    sized = sized.select(
        F.when(F.col("origin") == "val", "val").otherwise("train").alias("split"), "origin", "source_document", "document", "cut",
        F.when(F.col("cut"), last).otherwise(words).cast("int").alias("n_words"), targets.alias("target_num"),
        (targets > 0).cast("int").alias("group"))
    if settings.positives_only:
        sized = sized.where((F.col("group") == 1) | F.col("origin").isin("val", "extra"))
    sized = keep(sized)
    key = shuffle_key(settings.seed)
    return positions(sized, key, F.substring(key, 1, BUCKET_HEX), group_cols=("split",)).drop("n")


def cut_counts(word_rows: DataFrame, keep_last: int | None = TRUNCATE_LEFT_WORDS) -> DataFrame:
    """``(document, n_words, targets, cut_targets)`` for :func:`training_plan`: one aggregate over labelled words, or, of
    documents in one row, over their counts."""
    if "_ms" in word_rows.columns:
        return document_counts(word_rows, keep_last).groupBy("document").agg(
            F.max("n_words").alias("n_words"), F.sum("targets").alias("targets"), F.sum("cut_targets").alias("cut_targets"))
    hit = is_target(F.col("label")).cast("int")
    late = F.lit(True) if keep_last is None else F.col("token") >= F.col("n_words") - F.lit(keep_last)
    return word_rows.groupBy("document").agg(F.max("n_words").alias("n_words"), F.sum(hit).alias("targets"),
                                             F.sum(F.when(late, hit).otherwise(0)).alias("cut_targets"))


def plan_by_source(plan: DataFrame) -> DataFrame:
    """A :func:`training_plan` by the documents it reads, ``(document, _plan)``: all its columns, an entry for each example (two at
    most of a document)."""
    return plan.groupBy(F.col("source_document").alias("document")).agg(F.collect_list(F.struct(*plan.columns)).alias("_plan"))


def planned_examples(word_rows: DataFrame, plan: DataFrame | None, settings: TrainingSet = TrainingSet()) -> DataFrame:
    """The examples of a :func:`training_plan`: its columns with ``pieces`` (piece, start, end, label_id) and ``length``.

    Words are joined to the plan by source document, so only kept documents are cut into pieces;
    a document without words has no pieces and no row. Without a plan, ``word_rows`` are documents in one row that hold their
    entries of it (:func:`plan_by_source`): words and pieces never leave the row, and examples are not dealt.
    """
    if plan is None:
        return planned_documents(word_rows, settings.keep_last, settings.max_length)
    slim = plan.select(F.col("source_document").alias("_source"), F.col("document").alias("_new"), F.col("cut").alias("_cut"))
    each = word_rows.join(slim, word_rows["document"] == slim["_source"])
    skip = F.lit(0) if settings.keep_last is None else F.when(
        F.col("_cut"), F.greatest(F.col("n_words") - F.lit(settings.keep_last), F.lit(0))).otherwise(F.lit(0))
    rows = each.where(F.col("token") >= skip).select(
        F.col("_new").alias("document"), (F.col("token") - skip).cast("int").alias("token"), "word", "trailing_whitespace",
        (F.col("n_words") - skip).cast("int").alias("n_words"), "label")
    built = example_pieces(rows, settings.max_length)
    return plan.join(built, "document").withColumn("length", F.size("pieces"))
