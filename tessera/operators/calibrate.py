"""Threshold sweep: decode, chunk and score every threshold of a grid in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import F5_GATE, O_ID, RULE_LABELS, THRESHOLDS, RewriteMode
from ..functions.bio import is_begin_id, label_id, type_id_of
from .decode import firing_pieces
from .entities import _metrics
from .tokens import layout_by_document


def threshold_grid(step: float) -> list[float]:
    """The thresholds ``0, step, 2 * step, ...`` below 1."""
    if not 0 < step <= 1:
        raise ValueError("step must be above 0 and at most 1")
    grid, i = [], 0
    while round(i * step, 9) < 1:
        grid.append(round(i * step, 9))
        i += 1
    return grid


def per_threshold(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Repeat rows once per threshold (the grid is a parameter, not data)."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    return df.select(F.explode(grid).alias("threshold"), *df.columns)


def calibrate(cands: DataFrame, real_words: DataFrame, thresholds: Sequence[float] = THRESHOLDS,
              mode: int = 1, rules: DataFrame | None = None) -> DataFrame:
    """``(threshold, tp, n_pred, n_true, precision, recall, f5)`` for every threshold.

    ``cands``: :func:`tessera.operators.decode.candidates`; ``real_words``: true word labels
    ``(document, token, label)``, or with ``label_id``. All on integer label ids, with the thresholds side by side in a
    word's row: first firing piece per word and threshold and the true label by one hash aggregate, chunks and
    matches by one sorted pass (:func:`sweep_matches`). Rule hits (``rules``, prediction schema) replace model output for the rule
    labels and win on words they cover.
    """
    ts = [float(t) for t in thresholds]
    fired = firing_pieces(cands, ts, RULE_LABELS if rules is not None else None)
    keys = [f"_k{k}" for k in range(len(ts))]
    none = [F.lit(None).cast("long").alias(k) for k in keys]
    true_id = F.col("label_id") if "label_id" in real_words.columns else label_id(F.col("label"))
    truth = real_words.select("document", "token", *none, true_id.alias("_t")).where(F.col("_t") != O_ID)
    rows = fired.withColumn("_t", F.lit(None).cast("int")).unionByName(truth)
    if rules is not None:
        hits = rules.select("document", "token", *none, F.lit(None).cast("int").alias("_t"), label_id(F.col("label")).alias("_r"))
        rows = rows.withColumn("_r", F.lit(None).cast("int")).unionByName(hits)
    ruled = [F.min("_r").alias("_r")] if rules is not None else []
    # Dealt by document, so that the chunks of its words need no second shuffle.
    words = layout_by_document(rows).groupBy("document", "token").agg(*[F.min(k).alias(k) for k in keys], F.max("_t").alias("_t"), *ruled)
    model = [(F.col(k) % 16).cast("int") for k in keys]
    said = [F.coalesce("_r", m) for m in model] if rules is not None else model
    words = words.select("document", "token", *[m.alias(f"l{k}") for k, m in enumerate(said)], F.col("_t").alias("lt"))
    counts = sweep_matches(words, ts, mode)
    spark = cands.sparkSession
    grid = spark.range(len(ts)).select(
        F.element_at(F.array(*[F.lit(t) for t in ts]), (F.col("id") + 1).cast("int")).alias("threshold"))
    full = grid.join(counts, "threshold", "left").select(
        "threshold", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("tp", "n_pred", "n_true")])
    return _metrics(full)


def sweep_matches(words: DataFrame, thresholds: Sequence[float], mode: int) -> DataFrame:
    """``(threshold, tp, n_pred, n_true)`` from one row per word: ``(document, token, l0, l1, ..., lt)``, the label ids
    predicted at each threshold and the true one, null for ``O``.

    The chunks of :func:`tessera.operators.entities.entity_spans_ids` by their first and last words, without
    a row per chunk: a chunk starts where its label begins one (or, by ``mode``, where the word before doesn't continue it), and
    ends where the next word doesn't continue it. A predicted chunk is a true one if both end at the same word, with the
    same type and the same first word.
    """
    sides = [(f"l{k}", mode) for k in range(len(thresholds))] + [("lt", 0)]
    order = Window.partitionBy("document").orderBy("token")
    near = F.struct("token", *[c for c, _ in sides])
    x = words.select("document", "token", *[c for c, _ in sides], F.lag(near).over(order).alias("_a"), F.lead(near).over(order).alias("_z"))
    before, after = F.col("_a.token") == F.col("token") - 1, F.col("_z.token") == F.col("token") + 1
    starts, ends = [], []
    for c, m in sides:
        kind = type_id_of(F.col(c))
        follows = F.coalesce(before & (type_id_of(F.col(f"_a.{c}")) == kind), F.lit(False))
        goes_on = F.coalesce(after & (type_id_of(F.col(f"_z.{c}")) == kind), F.lit(False))
        opens = F.lit(False) if m == RewriteMode.REWRITE_BOTH else is_begin_id(F.col(c))
        next_opens = F.lit(False) if m == RewriteMode.REWRITE_BOTH else F.coalesce(is_begin_id(F.col(f"_z.{c}")), F.lit(False))
        starts.append((F.col(c).isNotNull() & (opens | ~follows)).alias(f"s_{c}"))
        ends.append((F.col(c).isNotNull() & ~(goes_on & ~next_opens)).alias(f"e_{c}"))
    x = x.select("document", "token", *[type_id_of(F.col(c)).alias(f"t_{c}") for c, _ in sides], *starts, *ends)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = [F.last(F.when(F.col(f"s_{c}"), F.col("token")), ignorenulls=True).over(running).alias(f"f_{c}") for c, _ in sides]
    x = x.select("*", *first)
    sums = [F.sum(F.col(f"s_{c}").cast("long")).alias(f"n_{c}") for c, _ in sides]
    for c, _ in sides[:-1]:
        same = F.col(f"e_{c}") & F.col("e_lt") & (F.col(f"t_{c}") == F.col("t_lt")) & (F.col(f"f_{c}") == F.col("f_lt"))
        sums.append(F.sum(F.when(same, 1).otherwise(0).cast("long")).alias(f"tp_{c}"))
    per_document = x.groupBy("document").agg(*sums)
    cells = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp_l{k}").alias("tp"), F.col(f"n_l{k}").alias("n_pred"),
                               F.col("n_lt").alias("n_true")) for k, t in enumerate(thresholds)])
    each = per_document.select(cells.alias("_cells")).select(F.inline_outer("_cells"))
    return each.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_true")])


def best_threshold(calibration: DataFrame) -> DataFrame:
    """The row with the highest F5; ties keep the lowest threshold; null F5 never wins."""
    return (calibration.where(F.col("f5").isNotNull() & ~F.isnan("f5"))
            .orderBy(F.col("f5").desc(), F.col("threshold").asc()).limit(1))


def quality_gate(best: DataFrame, gate: float = F5_GATE) -> DataFrame:
    """Flag a run whose best F5 is under the gate."""
    return best.withColumn("bad_run", F.col("f5") < F.lit(float(gate)))
