import math

import numpy as np
import pytest

from tessera.operators.calibrate import threshold_grid
from tessera.operators.scoring import (ensemble_columns, ensemble_scores, focal_loss, focal_loss_logits, hash_logits, score_pieces,
                                       score_with_model, side_by_side, softmax_scores, with_argmax)
from tessera.sources.tables import write_table
from tessera.schema import LOGIT_COLS, PROB_COLS


def _logits(spark, rows):
    return spark.createDataFrame([(0, i, *z) for i, z in enumerate(rows)],
                                 "document long, piece int, " + ", ".join(f"{c} double" for c in LOGIT_COLS))


def test_softmax_and_argmax_ties(spark):
    z = [[0.0] * 13, [1.0] + [0.0] * 11 + [1.0], [0.0] * 12 + [3.0]]
    s = with_argmax(softmax_scores(_logits(spark, z))).orderBy("piece").collect()
    for r in s:
        assert abs(sum(getattr(r, c) for c in PROB_COLS) - 1.0) < 1e-12
    assert [(r.l_all, r.l_no) for r in s] == [(0, 0), (0, 0), (12, 0)]


def test_focal_loss_reduces_to_cross_entropy(spark):
    z = [[0.5 * i for i in range(13)], [1.0] * 13, [0.0] * 12 + [2.0]]
    scores = softmax_scores(_logits(spark, z))
    labels = spark.createDataFrame([(0, 0, 3), (0, 1, 12), (0, 2, -100)], "document long, piece int, label_id int")
    got = focal_loss(scores, labels, gamma=0.0, alpha=[1.0] * 13).first()
    p = {r.piece: r for r in scores.collect()}
    ce = (-math.log(p[0].p3) - math.log(p[1].p12)) / 2
    assert got.n_rows == 2 and abs(got.loss - ce) < 1e-12
    empty = focal_loss(scores, labels.where("label_id = -100")).first()
    assert empty.loss == 0.0 and empty.n_rows == 0


def test_ensemble_of_one_is_identity(spark):
    scores = softmax_scores(_logits(spark, [[0.1 * i for i in range(13)], [0.3] * 13]))
    ens = ensemble_scores([(scores, 2.0)])
    a = {r.piece: [getattr(r, c) for c in PROB_COLS] for r in scores.collect()}
    b = {r.piece: [getattr(r, c) for c in PROB_COLS] for r in ens.collect()}
    for k in a:
        assert all(abs(x - y) < 1e-12 for x, y in zip(a[k], b[k]))


def test_focal_loss_keeps_rows_of_probability_zero(spark):
    scores = softmax_scores(_logits(spark, [[0.0] + [2000.0] * 12]))
    labels = spark.createDataFrame([(0, 0, 0)], "document long, piece int, label_id int")
    got = focal_loss(scores, labels).first()
    assert got.n_rows == 1 and math.isinf(got.loss)


def test_ensemble_members_must_hold_each_piece_once(spark):
    one = softmax_scores(_logits(spark, [[0.1] * 13]))
    with pytest.raises(Exception, match="disagree"):
        ensemble_scores([(one.unionByName(one), 1.0), (one.limit(0), 1.0)]).collect()


def test_model_sees_whole_documents_once_loaded(spark):
    """A model whose score depends on the whole sequence: the piece's rank from the end."""
    pieces = spark.createDataFrame(
        [(d, p, 4 * p, 4 * p + 4) for d, n in ((1, 3), (2, 5)) for p in range(n)],
        "document long, piece int, start int, end int").repartition(3, "piece")

    def load():
        def predict(doc):
            assert list(doc["piece"]) == list(range(len(doc)))
            out = np.zeros((len(doc), 13))
            out[:, 12] = len(doc) - 1 - np.arange(len(doc))
            return out
        return predict

    got = {(r.document, r.piece): r.p12 for r in score_with_model(pieces, load, ["piece"]).collect()}
    assert len(got) == 8
    for d, n in ((1, 3), (2, 5)):
        for p in range(n):
            z = np.exp(n - 1 - p)
            assert abs(got[d, p] - z / (z + 12)) < 1e-9


def test_grid_from_a_step():
    assert threshold_grid(0.25) == [0, 0.25, 0.5, 0.75]
    assert len(threshold_grid(0.01)) == 100 and threshold_grid(1) == [0]
    with pytest.raises(ValueError):
        threshold_grid(0)


def test_sink_partitions_and_sorts(spark, tmp_path):
    rows = [(t, d, k) for t in (0.25, 0.5) for d in (2, 1) for k in (1, 0)]
    write_table(spark.createDataFrame(rows, "threshold double, document long, token int").coalesce(1),
                str(tmp_path / "out"), ("threshold",))
    back = spark.read.parquet(str(tmp_path / "out" / "threshold=0.25")).collect()
    assert [(r.document, r.token) for r in back] == [(1, 0), (1, 1), (2, 0), (2, 1)]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_loss_from_logits_stays_finite_and_exact(spark):
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    rows = [[0.0] + [2000.0] * 12, [30.0] + [0.0] * 12, [-5.5, 1.25] + [0.5] * 11, [-700.0] * 12 + [700.0]]
    labels = spark.createDataFrame([(0, i, y) for i, y in enumerate([0, 0, 1, 3])] + [(0, 9, 1)], "document long, piece int, label_id int")
    got = {r.piece: r.loss for r in focal_loss_logits(_logits(spark, rows), labels, reduction="none").collect()}
    assert set(got) == {0, 1, 2, 3}
    for i, y in enumerate([0, 0, 1, 3]):
        z = [Decimal(x) for x in rows[i]]
        p = z[y].exp() / sum(x.exp() for x in z)
        want = (1 - p) ** 3 * -p.ln()
        assert math.isfinite(got[i]) and got[i] == pytest.approx(float(want), rel=1e-12)
    both = focal_loss(softmax_scores(_logits(spark, rows[1:3])), labels, reduction="sum").first()
    same = focal_loss_logits(_logits(spark, rows[1:3]), labels, reduction="sum").first()
    assert both.n_rows == same.n_rows == 2 and both.loss == pytest.approx(same.loss, rel=1e-6)
    with pytest.raises(ValueError):
        focal_loss_logits(_logits(spark, rows), labels, reduction="median")


def test_ensemble_of_columns_in_any_order(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, *[rng.random(13).tolist() for _ in range(3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "document long, piece int, a array<double>, b array<double>, c array<double>")
    weights = {"a": 1.0, "b": 0.3, "c": 2.7}
    first = ensemble_columns(df, weights).orderBy("piece").collect()
    for order in ("cab", "bca", "cba"):
        assert ensemble_columns(df, {m: weights[m] for m in order}).orderBy("piece").collect() == first
    assert first[7].p3 == pytest.approx(sum(rows[7][2 + k][3] * w for k, w in enumerate(weights.values())) / 4.0)
    one = softmax_scores(_logits(spark, [[0.1 * i for i in range(13)]]))
    assert ensemble_columns(side_by_side(one, "m"), {"m": 3.0}).first().p4 == pytest.approx(one.first().p4)
    with pytest.raises(ValueError):
        ensemble_columns(df, {})


def test_scores_of_the_default_scorer(spark):
    pieces = spark.createDataFrame([(1, 0, -1, 0, 0, None), (1, 1, 0, 0, 4, "B-EMAIL")],
                                   "document long, piece int, token int, start int, end int, word_label string")
    got = score_pieces(pieces).orderBy("piece").collect()
    assert [(r.start, r.end) for r in got] == [(0, 0), (0, 4)] and all(abs(sum(r[c] for c in PROB_COLS) - 1) < 1e-9 for r in got)
    assert score_pieces(pieces, lambda p: hash_logits(p, salt="b")).first() != got[0]


@pytest.mark.parametrize("streaming", [False, True])
def test_long_documents_reach_the_model_in_order(spark, streaming):
    """A document of many Arrow batches: whole for one kind of model, frame by frame for the other."""
    n = 2300
    pieces = spark.range(n + 5).selectExpr("if(id < 5, 2L, 1L) as document", "cast(if(id < 5, id, id - 5) as int) as piece",
                                           "cast(id as int) as start", "cast(id + 1 as int) as end").orderBy("end", ascending=False)
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")

    def load():
        def scores(frame, at):
            assert list(frame["piece"]) == list(range(at, at + len(frame)))
            return np.tile(frame["piece"].to_numpy(float)[:, None] / n, (1, 13))

        def predict(frame):
            return scores(frame, 0)

        def predict_stream(frames):
            at = 0
            for frame in frames:
                assert len(frame) <= 100
                yield scores(frame, at)
                at += len(frame)

        return predict_stream if streaming else predict

    try:
        got = score_with_model(pieces, load, [], outputs_logits=False, streaming=streaming).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert sorted((r.document, r.piece) for r in got) == [(1, i) for i in range(n)] + [(2, i) for i in range(5)]
    assert all(r.p0 == r.piece / n for r in got)


def test_a_model_must_score_every_piece(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 2)], "document long, piece int, start int, end int")
    with pytest.raises(Exception, match="scores for"):
        score_with_model(pieces, lambda: lambda frame: np.zeros((1, 13)), []).collect()
    with pytest.raises(Exception, match="without scores"):
        score_with_model(pieces, lambda: lambda frames: iter(()), [], streaming=True).collect()
