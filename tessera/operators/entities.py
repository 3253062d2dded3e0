"""Entities from BIO word labels and entity-level precision / recall / F5.

Chunking follows the lenient IOB2 rule: a chunk starts at ``B-``, or at ``I-`` after ``O``
or after another type, and ends before the next start or ``O``. On the sparse (non-O) rows
of dense word positions this is a gaps-and-islands pass: start flag -> running sum ->
group. No per-document lists are built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bio import ENTITY_TYPES, bio_prefix, bio_type, f_beta, is_begin_id, type_id_of
from ..schema import LABELS, O_ID, O_LABEL
from .decode import repaired_cells
from .scoring import with_argmax
from .sequences import label_lists
from .tokens import layout_by_document


def entity_spans(word_labels: DataFrame, keys: Sequence[str] = (), label_col: str = "label") -> DataFrame:
    """``(*keys, document, entity_type, start, end)``: one row per chunk (inclusive ends)."""
    keys = list(keys)
    rows = word_labels.where(F.col(label_col).isNotNull() & (F.col(label_col) != O_LABEL)).select(
        *keys, "document", "token", bio_prefix(F.col(label_col)).alias("_pfx"),
        bio_type(F.col(label_col)).alias("entity_type"))
    w = Window.partitionBy(*keys, "document").orderBy("token")
    starts = (
        (F.col("_pfx") == "B")
        | F.coalesce(F.lag("token").over(w) != F.col("token") - 1, F.lit(True))
        | F.coalesce(F.lag("entity_type").over(w) != F.col("entity_type"), F.lit(True))
    )
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = rows.withColumn("_start", starts.cast("int")).withColumn(
        "_island", F.sum("_start").over(running))
    return islands.groupBy(*keys, "document", "_island").agg(
        F.first("entity_type").alias("entity_type"),
        F.min("token").cast("int").alias("start"),
        F.max("token").cast("int").alias("end"),
    ).drop("_island")


def entity_spans_ids(word_label_ids: DataFrame, keys: Sequence[str] = (), mode: int = 0) -> DataFrame:
    """Entities straight from word label ids, with the BIO repair of ``mode`` folded in.

    ``cont`` = the previous non-O word is ``token - 1`` with the same type. A chunk starts
    where the (repaired) label is ``B-`` or ``cont`` fails; with repair modes 0 and 1 that
    is ``B- or not cont``, with mode 2 it is ``not cont``. One lag pass, one running sum,
    then an all-integer hash aggregate. Output ``(*keys, document, type_id, start, end)``.
    """
    keys = list(keys)
    rows = word_label_ids.where(F.col("label_id") != O_ID).select(
        *keys, "document", "token", type_id_of(F.col("label_id")).alias("type_id"),
        is_begin_id(F.col("label_id")).alias("_b"))
    w = Window.partitionBy(*keys, "document").orderBy("token")
    cont = F.coalesce((F.lag("token").over(w) == F.col("token") - 1)
                      & (F.lag("type_id").over(w) == F.col("type_id")), F.lit(False))
    starts = ~F.col("_cont") if mode == 2 else (F.col("_b") | ~F.col("_cont"))
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    islands = rows.withColumn("_cont", cont).withColumn("_start", starts.cast("int")).withColumn(
        "_island", F.sum("_start").over(running))
    return islands.groupBy(*keys, "document", "_island").agg(
        F.min("type_id").alias("type_id"), F.min("token").cast("int").alias("start"),
        F.max("token").cast("int").alias("end"),
    ).drop("_island")


def count_entity_matches(pred_ents: DataFrame, true_ents: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, tp, n_pred, n_true)`` by union and hash aggregation (no sort-merge join):
    an entity key seen on both sides is a true positive."""
    k = [*keys, "document", "type_id", "start", "end"]
    u = pred_ents.select(*k, F.lit(1).alias("_p"), F.lit(0).alias("_t")).unionByName(
        true_ents.select(*k, F.lit(0).alias("_p"), F.lit(1).alias("_t")))
    per_key = u.groupBy(*k).agg(F.max("_p").alias("_p"), F.max("_t").alias("_t"))
    return per_key.groupBy(*keys).agg(
        F.sum(F.col("_p") * F.col("_t")).cast("long").alias("tp"),
        F.sum("_p").cast("long").alias("n_pred"),
        F.sum("_t").cast("long").alias("n_true"),
    )


def entity_match(pred_ents: DataFrame, true_ents: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Outer match of predicted and true entities on ``(document, type, start, end)``:
    ``(*keys, document, entity_type, start, end, is_pred, is_true)``. A union and one hash
    aggregate per entity key (no sort-merge join)."""
    k = [*keys, "document", "entity_type", "start", "end"]
    u = pred_ents.select(*k, F.lit(True).alias("_p"), F.lit(False).alias("_t")).unionByName(
        true_ents.select(*k, F.lit(False).alias("_p"), F.lit(True).alias("_t")))
    return u.groupBy(*k).agg(F.max("_p").alias("is_pred"), F.max("_t").alias("is_true"))


def _metrics(counts: DataFrame) -> DataFrame:
    tp, n_pred, n_true = F.col("tp"), F.col("n_pred"), F.col("n_true")
    precision = F.when(n_pred > 0, tp / n_pred).otherwise(F.lit(0.0))
    recall = F.when(n_true > 0, tp / n_true).otherwise(F.lit(0.0))
    return counts.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f5", f_beta(F.col("precision"), F.col("recall")))


def count_matches(matched: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    c = matched.groupBy(*keys).agg(
        F.sum((F.col("is_pred") & F.col("is_true")).cast("long")).alias("tp"),
        F.sum(F.col("is_pred").cast("long")).alias("n_pred"),
        F.sum(F.col("is_true").cast("long")).alias("n_true"),
    )
    return c


def entity_f5_micro(pred_ents: DataFrame, true_ents: DataFrame) -> DataFrame:
    """One row ``(tp, n_pred, n_true, precision, recall, f5)``; precision / recall are 0 on
    an empty denominator and F5 is null when both are 0."""
    c = count_matches(entity_match(pred_ents, true_ents))
    c = c.select(*[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in ("tp", "n_pred", "n_true")])
    return _metrics(c)


def entity_f5_by_type(pred_ents: DataFrame, true_ents: DataFrame,
                      labels: Sequence[str] = LABELS) -> DataFrame:
    """Per entity type ``(entity_type, tp, n_pred, n_true, precision, recall, f5)``.

    Every type of the label vocabulary appears (F5 null when it never occurs), plus any
    other type seen in the data.
    """
    c = count_matches(entity_match(pred_ents, true_ents), ["entity_type"])
    vocab_types = sorted({x[2:] for x in labels if x.startswith("B-")})
    spark = pred_ents.sparkSession
    counts = ("tp", "n_pred", "n_true")
    zero = spark.createDataFrame([(t, 0, 0, 0) for t in vocab_types], "entity_type string, tp long, n_pred long, n_true long")
    both = c.select("entity_type", *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in counts]).unionByName(zero)
    return _metrics(both.groupBy("entity_type").agg(*[F.sum(x).alias(x) for x in counts]))


def piece_metrics(scores: DataFrame, labels: DataFrame, ignore_index: int = -100) -> DataFrame:
    """Entity metrics on pieces, as seen while training: ``(entity_type, tp, n_pred, n_true,
    precision, recall, f5)``, one row per type of the vocabulary and one named ``micro``.

    The arg-max label of each scored piece against ``labels(document, piece, label_id)``. Pieces
    labelled ``ignore_index`` are dropped and the rest close up, so a chunk runs across them.
    Predicted and true labels share one window pass, keyed by side.
    """
    best = with_argmax(scores).select("document", "piece", F.col("l_all").alias("_pred"))
    return piece_metrics_labelled(best.join(labels, ["document", "piece"]), ignore_index)


def piece_metrics_labelled(rows: DataFrame, ignore_index: int = -100, gapless: bool = False) -> DataFrame:
    """:func:`piece_metrics` of ``(document, piece, _pred, label_id)``, arg-max and true label on a piece's row: no join.

    ``gapless``: the pieces that aren't ignored are numbered without gaps in a document (its head and tail alone are ignored), so
    their numbers serve as they are, and those that are ``O`` on both sides, in no chunk, needn't be dealt or sorted.
    """
    kept = rows.where(F.col("label_id") != ignore_index)
    if gapless:
        closed = layout_by_document(kept.where((F.col("_pred") != O_ID) | (F.col("label_id") != O_ID))).withColumnRenamed("piece", "token")
    else:
        closed = kept.withColumn("token", F.row_number().over(Window.partitionBy("document").orderBy("piece")))
    closed = closed.select("document", "token", F.array(
        F.struct(F.lit(1).alias("pred"), F.col("_pred").alias("label_id")),
        F.struct(F.lit(0).alias("pred"), F.col("label_id"))).alias("_ss"))
    closed = closed.select("document", "token", F.explode_outer("_ss").alias("_s"))
    chunks = entity_spans_ids(closed.select(F.col("_s.pred").alias("pred"), "document", "token",
                                            F.col("_s.label_id").alias("label_id")), ["pred"])
    seen = chunks.groupBy("document", "type_id", "start", "end").agg(
        F.max("pred").alias("_p"), F.max(1 - F.col("pred")).alias("_t"))
    counts = seen.groupBy("type_id").agg(
        F.sum(F.col("_p") * F.col("_t")).alias("tp"), F.sum("_p").alias("n_pred"), F.sum("_t").alias("n_true"))
    zero = rows.sparkSession.createDataFrame(
        [(i, 0, 0, 0) for i in range(len(ENTITY_TYPES))], "type_id int, tp long, n_pred long, n_true long")
    rolled = counts.unionByName(zero).rollup("type_id").agg(
        F.grouping("type_id").alias("_all"), *[F.sum(x).alias(x) for x in ("tp", "n_pred", "n_true")])
    name = F.element_at(F.array(*[F.lit(t) for t in ENTITY_TYPES]), F.coalesce("type_id", F.lit(0)) + 1)
    return _metrics(rolled.select(F.when(F.col("_all") == 1, "micro").otherwise(name).alias("entity_type"),
                                  "tp", "n_pred", "n_true"))


def align_real_pred(real: DataFrame | None, preds: DataFrame) -> DataFrame:
    """Full outer join of true word labels and predictions on ``(document, token)``.

    ``real``: ``(document, token, token_value, label)``; ``preds``: prediction schema.
    Missing labels become ``O``; other missing values stay null. Without ``real``, ``preds`` are documents that hold the true
    labels next to what is said (:mod:`tessera.operators.sequences`), both by place: aligned as they are.
    """
    if real is None:
        return preds.select("document", "real", "said0")
    r = real.select("document", "token", "token_value", F.col("label").alias("label_real"))
    p = preds.select("document", "token", F.col("label").alias("label_pred"), "token_str", "score")
    j = r.join(p, ["document", "token"], "full_outer")
    return j.select(
        "document", "token", "token_value",
        F.coalesce("label_real", F.lit(O_LABEL)).alias("label_real"),
        F.coalesce("label_pred", F.lit(O_LABEL)).alias("label_pred"),
        "token_str", "score",
    )


def _real_with_grid(real: DataFrame, preds: DataFrame, thresholds: Sequence[float],
                    modes: Sequence[int]) -> tuple[list[tuple[int, float]], DataFrame]:
    """The grid's cells, and ``(document, token, token_value, label_real, _by)``: of each word what is predicted, by cell."""
    cells = [(m, float(t)) for m in modes for t in thresholds]
    cell = F.coalesce(*[F.when((F.col("mode") == m) & (F.col("threshold") == t), i) for i, (m, t) in enumerate(cells)])
    entry = F.struct(cell.alias("_cell"), F.struct("label", "token_str", "score").alias("_said"))
    folded = preds.where(cell.isNotNull()).groupBy("document", "token").agg(F.map_from_entries(F.collect_list(entry)).alias("_by"))
    r = real.select("document", "token", "token_value", F.col("label").alias("label_real"))
    joined = r.join(folded, ["document", "token"], "full_outer")
    return cells, joined


def align_real_pred_sweep(real: DataFrame, preds: DataFrame, thresholds: Sequence[float],
                          modes: Sequence[int]) -> DataFrame:
    """:func:`align_real_pred` for every rewrite mode and threshold, by one outer join.

    ``preds``: the prediction schema with ``mode, threshold``. A word's predictions are folded into one map keyed by
    grid cell (at most ``modes * thresholds`` entries), the maps are joined to the true words once, and the grid is
    spread out at the output. Output ``(mode, threshold, document, token, token_value, label_real, label_pred, token_str, score)``.
    """
    cells, joined = _real_with_grid(real, preds, thresholds, modes)
    grid = F.array(*[F.struct(F.lit(i).alias("_cell"), F.lit(m).alias("mode"), F.lit(t).alias("threshold"))
                     for i, (m, t) in enumerate(cells)])
    spread = joined.select("document", "token", "token_value", "label_real", "_by", F.inline(grid))
    said = F.try_element_at("_by", F.col("_cell"))
    spread = spread.select("mode", "threshold", "document", "token", "token_value", "label_real", said.alias("_said"))
    return spread.select("mode", "threshold", "document", "token", "token_value",
                         F.coalesce("label_real", F.lit(O_LABEL)).alias("label_real"),
                         F.coalesce("_said.label", F.lit(O_LABEL)).alias("label_pred"),
                         F.col("_said.token_str").alias("token_str"), F.col("_said.score").alias("score"))


def error_report(aligned: DataFrame) -> DataFrame:
    """Misses and wrong types: ``label_pred <> label_real`` where the truth is not ``O``."""
    return aligned.where((F.col("label_pred") != F.col("label_real")) & (F.col("label_real") != O_LABEL))


def error_report_sweep(real: DataFrame, preds: DataFrame, thresholds: Sequence[float],
                       modes: Sequence[int]) -> DataFrame:
    """:func:`error_report` for every rewrite mode and threshold.

    ``preds``: the prediction schema with ``mode, threshold``, or one row per word with the grid side by side
    (:func:`tessera.operators.decode.with_continuation`), joined as it is and spread out for the words found alone. Only words whose truth is not
    ``O`` are repeated over the grid; a word without a prediction is a miss, predicted ``O``.
    """
    if "said" in preds.columns:
        missed = real.where(F.col("label") != O_LABEL).select("document", "token", "token_value", F.col("label").alias("label_real"))
        cells = repaired_cells(missed.join(preds, ["document", "token"], "left"), thresholds, modes)
        said = F.col("label").isNotNull()
        return cells.withColumn("label_pred", F.coalesce("label", F.lit(O_LABEL))).where("label_pred <> label_real").select(
            "mode", "threshold", "document", "token", "token_value", "label_real", "label_pred",
            F.when(said, F.col("token_str")).alias("token_str"), F.when(said, F.col("score")).alias("score"))
    grid = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(float(t)).alias("threshold"))
                     for m in modes for t in thresholds])
    wanted = real.where(F.col("label") != O_LABEL).select(
        "document", "token", "token_value", F.col("label").alias("label_real"), F.inline(grid))
    p = preds.select("mode", "threshold", "document", "token", F.col("label").alias("_pred"), "token_str", "score")
    j = wanted.join(p, ["mode", "threshold", "document", "token"], "left").withColumn(
        "label_pred", F.coalesce("_pred", F.lit(O_LABEL)))
    return j.where("label_pred <> label_real").select(
        "mode", "threshold", "document", "token", "token_value", "label_real", "label_pred", "token_str", "score")


def label_sequences(aligned: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per document the ordered true and predicted label lists (for export). Documents in one row need no grouping."""
    if "real" in aligned.columns:
        return label_lists(aligned)
    g = aligned.groupBy(*keys, "document").agg(
        F.array_sort(F.collect_list(F.struct("token", "label_real", "label_pred"))).alias("_s"))
    return g.select(
        *keys, "document",
        F.transform("_s", lambda s: s["label_real"]).alias("labels_real"),
        F.transform("_s", lambda s: s["label_pred"]).alias("labels_pred"),
    )


def label_sequences_sweep(real: DataFrame | None, preds: DataFrame, thresholds: Sequence[float], modes: Sequence[int]) -> DataFrame:
    """:func:`label_sequences` of :func:`align_real_pred_sweep`, ``(mode, threshold, document, labels_real, labels_pred)``.

    A word is gathered once, with its predictions of all cells side by side; the grid is spread over whole lists. Without
    ``real``, ``preds`` are documents in one row that hold the true labels as well (:func:`align_real_pred`).
    """
    if real is None:
        return label_lists(preds, [(m, float(t)) for m in modes for t in thresholds])
    cells, joined = _real_with_grid(real, preds, thresholds, modes)
    said = F.array(*[F.coalesce(F.try_element_at("_by", F.lit(i))["label"], F.lit(O_LABEL)) for i in range(len(cells))])
    words = joined.select("document", "token", F.coalesce("label_real", F.lit(O_LABEL)).alias("real"), said.alias("preds"))
    listed = words.groupBy("document").agg(F.sort_array(F.collect_list(F.struct("token", "real", "preds"))).alias("_s"))

    def of_cell(i: int) -> F.Column:
        return F.transform("_s", lambda s: s["preds"][i])

    lists = [of_cell(i) for i in range(len(cells))]
    each = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(t).alias("threshold"), p.alias("labels_pred"))
                     for (m, t), p in zip(cells, lists)])
    whole = listed.select("document", F.transform("_s", lambda s: s["real"]).alias("labels_real"), each.alias("_each"))
    return whole.select("document", "labels_real", F.inline_outer("_each")).select(
        "mode", "threshold", "document", "labels_real", "labels_pred")
