"""Scores -> word-level BIO predictions, for one decision threshold or a whole sweep.

Per piece the arg-max labels reduce the threshold rule ``p_O < t ? best non-O : best`` to
``(l_no, always, p_o)``: a piece whose overall best is not ``O`` carries that label at every
threshold; otherwise it carries ``l_no`` exactly when ``p_O < t``. So one pass computes, per
word and threshold, the first piece that is not ``O`` (a min over pieces), pieces that can
never fire are dropped before anything multiplies by the grid, and no threshold is decoded
separately.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bio import bio_prefix, bio_type, label_name, type_id_of
from ..schema import LABEL_TO_ID, O_ID, RewriteMode
from .pieces import align_pieces
from .scoring import with_argmax
from .sequences import repaired_documents, said_by_document
from .tokens import layout_by_document

PRED_COLS = ("document", "token", "label", "token_str", "score")
ARGMAX_COLS = ("l_all", "l_no", "p_o", "p_all", "p_no")


def candidates(scores: DataFrame, words: DataFrame, max_pieces: int | None = None,
               with_token_str: bool = True) -> DataFrame:
    """Scored pieces aligned to words: ``(document, piece, token[, token_str], start, end,
    l_all, l_no, p_o, p_all, p_no)``.

    ``scores`` carries each piece's character offsets next to its probabilities, so the
    alignment hands the arg-max columns straight through (no join back to the pieces).
    ``max_pieces`` applies a right cut: pieces past it get no prediction.

    Filters on the arg-max columns belong after the alignment window (the sweep does so):
    pushed below it, they would be rewritten through every softmax projection.
    """
    if max_pieces is not None:
        scores = scores.where(F.col("piece") <= max_pieces - 2)
    s = with_argmax(scores).select("document", "piece", "start", "end", *ARGMAX_COLS)
    return align_pieces(s, words, carry=ARGMAX_COLS, with_token_str=with_token_str)


def aligned_candidates(scores: DataFrame) -> DataFrame:
    """:func:`candidates` of scored pieces that carry the word they are aligned to as ``at`` (-1: none), and its string
    as ``token_str`` if wanted (:func:`tessera.operators.in_row.piece_rows`).

    The arg-max columns come from a generator: later filters on them aren't rewritten through every softmax projection.
    Heads that hold the ``labels`` of a document's words stay, before the pieces of the document.
    """
    s = with_argmax(scores.where("at >= 0 or labels is not null" if "labels" in scores.columns else "at >= 0"))
    kept = ["document", "piece", F.col("at").alias("token"), *[c for c in ("token_str", "start", "end", "labels") if c in scores.columns]]
    s = s.select(*kept, F.array(F.struct(*ARGMAX_COLS)).alias("_best"))
    return s.select(*s.columns[:-1], F.inline_outer("_best"))


def _ignored_ids(ignored_labels: Sequence[str] | None) -> list[int]:
    return [LABEL_TO_ID[x] for x in (ignored_labels or ())]


def sweep_words(cands: DataFrame, thresholds: Sequence[float],
                ignored_labels: Sequence[str] | None = None, side_by_side: bool = False) -> DataFrame:
    """First non-O piece of every word at every threshold (before BIO repair).

    Output ``(threshold, document, token, token_str, label, score)``; ``score`` is the
    probability of the emitted label. See :func:`sweep_word_ids`. ``side_by_side``: one row per word instead,
    ``(document, token, token_str, said)``, with an entry ``threshold, label_id, score`` per threshold (null: ``O``).

    Candidates in document order behind heads with the true ``labels`` become one row per document, without a shuffle
    (:func:`tessera.operators.sequences.said_by_document`).
    """
    if "labels" in cands.columns:
        live = firing_pieces(cands, [float(t) for t in thresholds], ignored_labels, keys=("document", "labels", "token"),
                             besides=F.col("labels").isNotNull())
        return said_by_document(live, len(thresholds))
    ids = sweep_word_ids(cands, thresholds, ignored_labels, with_score=True,
                         keys=("document", "token", "token_str"), side_by_side=side_by_side)
    if side_by_side:
        return ids
    return ids.select("threshold", "document", "token", "token_str",
                      label_name(F.col("label_id")).alias("label"), "score")


def firing_pieces(cands: DataFrame, ts: Sequence[float], ignored_labels: Sequence[str] | None = None,
                  with_score: bool = False, keys: Sequence[str] = ("document", "token"), besides: Column | None = None) -> DataFrame:
    """The pieces that fire at some threshold: ``(*keys, _k0, _k1, ...[, _p])``, of each threshold the packed piece and
    label (``piece * 16 + label_id``) or null, and the label's probability. Rows that ``besides`` holds for stay as well."""
    always = F.col("l_all") != O_ID
    ign = _ignored_ids(ignored_labels)
    keep = (always & ~F.col("l_all").isin(*ign)) if ign else always
    keep_o = (~always & ~F.col("l_no").isin(*ign)) if ign else ~always
    fires = keep | (keep_o & (F.col("p_o") < F.lit(max(ts))))
    live = cands.where(fires if besides is None else fires | besides)
    packed = F.col("piece").cast("long") * 16 + F.when(always, F.col("l_all")).otherwise(F.col("l_no"))
    score = [F.when(always, F.col("p_all")).otherwise(F.col("p_no")).alias("_p")] if with_score else []
    return live.select(*keys, *[F.when(keep | (keep_o & (F.col("p_o") < F.lit(t))), packed).alias(f"_k{k}")
                                for k, t in enumerate(ts)], *score)


def sweep_word_ids(cands: DataFrame, thresholds: Sequence[float],
                   ignored_labels: Sequence[str] | None = None, with_score: bool = False,
                   keys: Sequence[str] = ("document", "token"), side_by_side: bool = False) -> DataFrame:
    """:func:`sweep_words` on label ids, as a hash aggregate.

    The first firing piece of a word and its label are packed into one long
    (``piece * 16 + label_id``), so "first piece wins" is a plain ``min`` per threshold;
    the score, when asked for, is ``min_by`` over the same key. Output ``(threshold, *keys,
    label_id[, score])``. Pieces are dealt by document, so that neither the aggregate nor the repair of a document's words
    deals them again.
    """
    ts = [float(t) for t in thresholds]
    live = layout_by_document(firing_pieces(cands, ts, ignored_labels, with_score, keys))
    aggs = []
    for k in range(len(ts)):
        aggs.append(F.min(f"_k{k}").alias(f"_k{k}"))
        if with_score:
            aggs.append(F.min_by("_p", f"_k{k}").alias(f"_s{k}"))
    per_word = live.groupBy(*keys).agg(*aggs)
    parts = []
    for k, t in enumerate(ts):
        fields = [F.lit(t).alias("threshold"), F.col(f"_k{k}").alias("k")]
        if with_score:
            fields.append(F.col(f"_s{k}").alias("s"))
        parts.append(F.struct(*fields))
    if side_by_side:
        said = [F.struct(x["threshold"].alias("threshold"), (x["k"] % 16).cast("int").alias("label_id"),
                         *([x["s"].alias("score")] if with_score else [])) for x in parts]
        return per_word.select(*keys, F.array(*said).alias("said"))
    each = per_word.select(*keys, F.array(*parts).alias("_xs"))
    stacked = each.select(*keys, F.explode_outer("_xs").alias("_x")).where(F.col("_x.k").isNotNull())
    out = [F.col("_x.threshold").alias("threshold"), *keys, (F.col("_x.k") % 16).cast("int").alias("label_id")]
    if with_score:
        out.append(F.col("_x.s").alias("score"))
    return stacked.select(*out)


def _with_cont(word_preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_cont``: the previous emitted word is ``token - 1`` with the same type."""
    w = Window.partitionBy(*keys, "document").orderBy("token")
    typ = bio_type(F.col("label"))
    return word_preds.withColumn("_cont", F.coalesce(
        (F.lag("token").over(w) == F.col("token") - 1) & (F.lag(typ).over(w) == typ), F.lit(False)))


def _repaired(mode: int) -> Column:
    """The label under a rewrite mode, from ``label`` and ``_cont``."""
    if mode == RewriteMode.NO_REWRITE:
        return F.col("label")
    prefix, typ = bio_prefix(F.col("label")), bio_type(F.col("label"))
    new = F.when((prefix == "I") & ~F.col("_cont"), F.concat(F.lit("B-"), typ))
    if mode == RewriteMode.REWRITE_BOTH:
        new = new.when((prefix == "B") & F.col("_cont"), F.concat(F.lit("I-"), typ))
    return new.otherwise(F.col("label"))


def repair_bio(word_preds: DataFrame, mode: int, keys: Sequence[str] = ("threshold",)) -> DataFrame:
    """BIO repair over emitted (non-O) words in position order.

    ``cont``: the previous emitted word of the document is ``token - 1`` with the same type.
    Mode 1 turns ``I-`` without ``cont`` into ``B-``; mode 2 also turns ``B-`` with ``cont``
    into ``I-``; mode 0 leaves labels alone. Rewriting keeps types, so one ``lag`` suffices. Documents of :func:`sweep_words`
    in one row are repaired inside it.
    """
    if "real" in word_preds.columns:
        return repaired_documents(word_preds, [mode])
    if mode == RewriteMode.NO_REWRITE:
        return word_preds
    return _with_cont(word_preds, keys).withColumn("label", _repaired(mode)).drop("_cont")


def repair_bio_modes(word_preds: DataFrame, modes: Sequence[int] = RewriteMode.ALL,
                     keys: Sequence[str] = ("threshold",)) -> DataFrame:
    """:func:`repair_bio` under several modes at once, one row per word and ``mode``: one window. Documents in one row hold what
    each mode and threshold says, by mode first."""
    if "real" in word_preds.columns:
        return repaired_documents(word_preds, modes)
    each = F.array(*[F.struct(F.lit(m).alias("mode"), _repaired(m).alias("label")) for m in modes])
    rest = [c for c in word_preds.columns if c != "label"]
    return _with_cont(word_preds, keys).select(*rest, each.alias("_each")).select(*rest, F.inline_outer("_each"))


def with_continuation(words: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Add ``_conts`` to words with their thresholds side by side (:func:`sweep_words`): for each, whether the word before is
    ``token - 1`` and says the same type. One window for the whole grid; :func:`repaired_cells` applies the modes."""
    before = F.lag(F.struct("token", F.col("said.label_id").alias("ids"))).over(Window.partitionBy("document").orderBy("token"))
    x = words.withColumn("_a", before)
    return x.withColumn("_conts", F.array(*[
        F.coalesce((F.col("_a.token") == F.col("token") - 1)
                   & (type_id_of(F.col("_a.ids")[i]) == type_id_of(F.col("said")[i]["label_id"])), F.lit(False))
        for i in range(len(thresholds))])).drop("_a")


def repaired_cells(words: DataFrame, thresholds: Sequence[float], modes: Sequence[int]) -> DataFrame:
    """Rows of :func:`with_continuation` spread over the grid: ``said`` and ``_conts`` become ``(mode, threshold, label,
    score)`` with the label repaired by each mode, null where nothing is said (or a row has no ``said``)."""
    rest = [c for c in words.columns if c not in ("said", "_conts")]
    ids = [F.col("said")[i]["label_id"] for i in range(len(thresholds))]
    # The test keeps the label nullable: an element of an array of literals is taken for one that is always there.
    each = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.when(y.isNotNull(), label_name(y)).alias("label"),
                              F.col("said")[i]["score"].alias("score"), F.col("_conts")[i].alias("_cont"))
                     for i, (t, y) in enumerate(zip(thresholds, ids))])
    x = words.select(*rest, each.alias("_each")).select(*rest, F.inline_outer("_each"))
    by_mode = F.array(*[F.struct(F.lit(m).alias("mode"), _repaired(m).alias("label")) for m in modes])
    x = x.select(*rest, "threshold", "score", by_mode.alias("_each"))
    return x.select(*rest, "threshold", "score", F.inline_outer("_each"))


def decode_sweep(cands: DataFrame, thresholds: Sequence[float], mode: int,
                 ignored_labels: Sequence[str] | None = None) -> DataFrame:
    """Word predictions at every threshold: ``(threshold, document, token, label,
    token_str, score)``."""
    return repair_bio(sweep_words(cands, thresholds, ignored_labels), mode)


def decode(cands: DataFrame, threshold: float, mode: int,
           ignored_labels: Sequence[str] | None = None) -> DataFrame:
    """Word predictions at one threshold in the prediction schema; with candidates behind heads, documents in one row."""
    words = decode_sweep(cands, [threshold], mode, ignored_labels)
    return words if "real" in words.columns else words.select(*PRED_COLS)


def rules_plus_model(model_preds: DataFrame, rule_preds: DataFrame, dedupe: bool = True,
                     keys: Sequence[str] = ()) -> DataFrame:
    """Add rule hits to model predictions. ``dedupe`` keeps one row per word, the rule's;
    ``dedupe=False`` is the plain bag union (a word may then appear twice)."""
    cols = [*keys, *PRED_COLS]
    m = model_preds.select(*cols, F.lit(1).alias("_src"))
    r = rule_preds.select(*cols, F.lit(0).alias("_src"))
    u = r.unionByName(m)
    if not dedupe:
        return u.drop("_src")
    w = Window.partitionBy(*keys, "document", "token").orderBy("_src", "label")
    return u.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_src")


def threshold_pick(scores: DataFrame, threshold: float) -> DataFrame:
    """Per piece label id at one threshold: ``p_O < t`` -> best non-O, else overall best."""
    s = with_argmax(scores)
    return s.select(
        "document", "piece",
        F.when(F.col("p_o") < F.lit(float(threshold)), F.col("l_no")).otherwise(F.col("l_all")).alias("label_id"),
    )
