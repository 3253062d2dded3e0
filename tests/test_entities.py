import random

from tessera.operators.calibrate import best_threshold, quality_gate
from tessera.operators.decode import repair_bio_modes, sweep_words, with_continuation
from tessera.operators.entities import align_real_pred, align_real_pred_sweep, entity_f5_micro, entity_spans, error_report_sweep, piece_metrics
from tessera.schema import LABELS, O_ID


def _chunks(labels):
    """Restatement of lenient IOB2 chunking over a dense label sequence."""
    out, cur, prev = [], None, "O"
    for i, lab in enumerate(labels + ["O"]):
        tag, typ, ptag, ptyp = lab[0], lab[2:], prev[0], prev[2:]
        if cur is not None and (tag in "BO" or typ != ptyp):
            out.append((cur[0], cur[1], i - 1))
            cur = None
        if tag == "B" or (tag == "I" and (ptag == "O" or ptyp != typ)):
            cur = (typ, i)
        prev = lab
    return out


def test_chunking_matches_lenient_rule(spark):
    rng = random.Random(11)
    pool = ["O", "O", "O", "B-EMAIL", "I-ID_NUM", "B-ID_NUM", "I-NAME_STUDENT", "B-NAME_STUDENT", "I-PHONE_NUM"]
    data, expected = [], []
    for doc in range(150):
        seq = [rng.choice(pool) for _ in range(rng.randint(0, 20))]
        data += [(doc, i, lab) for i, lab in enumerate(seq)]
        expected += [(doc, *c) for c in _chunks(seq)]
    df = spark.createDataFrame(data or [(0, 0, "O")], "document long, token int, label string")
    got = sorted((r.document, r.entity_type, r.start, r.end) for r in entity_spans(df).collect())
    assert got == sorted(expected)


def test_zero_f5_is_null(spark):
    cols = "document long, entity_type string, start int, end int"
    pred = spark.createDataFrame([(0, "EMAIL", 1, 1)], cols)
    true = spark.createDataFrame([(0, "EMAIL", 2, 2)], cols)
    row = entity_f5_micro(pred, true).first()
    assert (row.tp, row.n_pred, row.n_true, row.precision, row.recall, row.f5) == (0, 1, 1, 0.0, 0.0, None)


def test_best_threshold_ties_and_nulls(spark):
    cal = spark.createDataFrame([(0.0, 0.5), (0.25, 0.5), (0.5, 0.4), (0.75, None)], "threshold double, f5 double")
    best = best_threshold(cal).collect()
    assert [(r.threshold, r.f5) for r in best] == [(0.0, 0.5)]
    gate = quality_gate(best_threshold(cal)).first()
    assert gate.bad_run is True
    none = spark.createDataFrame([(0.0, None)], "threshold double, f5 double")
    assert best_threshold(none).count() == 0
    assert LABELS[-1] == "O"


def test_piece_metrics_close_up_ignored_pieces(spark):
    """The ignored piece between B- and I- is dropped, so both make one entity."""
    b, i = LABELS.index("B-NAME_STUDENT"), LABELS.index("I-NAME_STUDENT")
    true, pred = [O_ID, b, -100, i, O_ID], [O_ID, b, O_ID, i, LABELS.index("B-EMAIL")]
    scores = spark.createDataFrame(
        [(1, k, *[1.0 if y == c else 0.0 for c in range(len(LABELS))]) for k, y in enumerate(pred)],
        "document long, piece int, " + ", ".join(f"p{c} double" for c in range(len(LABELS))))
    labels = spark.createDataFrame([(1, k, y) for k, y in enumerate(true)], "document long, piece int, label_id int")
    got = {r.entity_type: (r.tp, r.n_pred, r.n_true) for r in piece_metrics(scores, labels).collect()}
    assert got["NAME_STUDENT"] == (1, 1, 1) and got["EMAIL"] == (0, 1, 0) and got["USERNAME"] == (0, 0, 0)
    assert got["micro"] == (1, 2, 1) and len(got) == 8
    empty = {r.entity_type: (r.tp, r.f5) for r in piece_metrics(scores.limit(0), labels).collect()}
    assert empty["micro"] == (0, None) and len(empty) == 8


def test_error_report_sweep_counts_missing_predictions(spark):
    real = spark.createDataFrame([(1, 0, "a", "B-EMAIL"), (1, 1, "b", "O"), (1, 2, "c", "B-ID_NUM")],
                                 "document long, token int, token_value string, label string")
    preds = spark.createDataFrame([(0, 0.5, 1, 0, "B-EMAIL", "a", 0.9), (0, 0.5, 1, 1, "B-EMAIL", "b", 0.8)],
                                  "mode int, threshold double, document long, token int, label string, token_str string, score double")
    got = sorted((r.mode, r.threshold, r.token, r.label_pred) for r in error_report_sweep(real, preds, [0.5], [0, 1]).collect())
    assert got == [(0, 0.5, 2, "O"), (1, 0.5, 0, "O"), (1, 0.5, 2, "O")]


def test_aligned_grid_equals_one_alignment_per_cell(spark):
    rng = random.Random(2)
    real = spark.createDataFrame([(d, k, f"w{k}", rng.choice(["O", "B-EMAIL"])) for d in range(3) for k in range(8)],
                                 "document long, token int, token_value string, label string")
    rows = [(m, t, d, k, rng.choice(["B-EMAIL", "I-ID_NUM"]), f"w{k}", rng.random()) for m in (0, 1, 2) for t in (0.0, 0.5)
            for d in range(4) for k in range(9) if rng.random() < 0.4]  # document 3 and word 8 have no true label
    preds = spark.createDataFrame(rows, "mode int, threshold double, document long, token int, label string, token_str string, score double")
    grid = align_real_pred_sweep(real, preds, [0.0, 0.5], [0, 2])
    assert grid._jdf.queryExecution().executedPlan().toString().count("Join") == 1
    every = {(r.document, r.token) for r in preds.where("mode in (0, 2)").collect()} | {(d, k) for d in range(3) for k in range(8)}
    for m in (0, 2):
        for t in (0.0, 0.5):
            one = {(r.document, r.token): tuple(r) for r in align_real_pred(real, preds.where(f"mode = {m} and threshold = {t}")).collect()}
            cell = {(r.document, r.token): tuple(r)[2:] for r in grid.where(f"mode = {m} and threshold = {t}").collect()}
            # A word that only another cell predicts is an O on both sides here.
            assert cell == {k: one.get(k, (*k, None, "O", "O", None, None)) for k in every}


def test_error_report_of_the_grid_side_by_side(spark):
    """One row per word through window and join; the same rows as from every cell decoded and repaired alone."""
    rng = random.Random(4)
    real = spark.createDataFrame([(d, k, f"w{k}", rng.choice(["O", "B-EMAIL", "I-ID_NUM"])) for d in range(4) for k in range(30)],
                                 "document long, token int, token_value string, label string")
    ids = [LABELS.index(x) for x in ("B-EMAIL", "B-ID_NUM", "I-ID_NUM", "I-PHONE_NUM")]
    rows = [(d, 2 * k + j, k, f"w{k}", rng.choice([*ids, LABELS.index("O")]), rng.choice(ids), rng.random(), rng.random(), rng.random())
            for d in range(5) for k in range(31) for j in range(2) if rng.random() < 0.6]
    cands = spark.createDataFrame(rows, "document long, piece int, token int, token_str string, l_all int, l_no int, "
                                        "p_o double, p_all double, p_no double")
    ts, modes = [0.0, 0.25, 0.75], [0, 1, 2]
    stacked = error_report_sweep(real, repair_bio_modes(sweep_words(cands, ts), modes), ts, modes)
    words = with_continuation(sweep_words(cands, ts, side_by_side=True), ts)
    got = error_report_sweep(real, words, ts, modes)
    want = sorted(map(tuple, stacked.collect()), key=repr)
    assert got.columns == stacked.columns and len(want) > 100 and any(r[0] == 2 and r[6].startswith("I-") for r in want)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert words.count() < sweep_words(cands, ts).count()
