import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.decode import decode, repair_bio, rules_plus_model, sweep_word_ids, sweep_words
from tessera.operators.entities import entity_spans, entity_spans_ids
from tessera.schema import LABELS, RewriteMode

CAND_SCHEMA = ("document long, piece int, token int, token_str string, l_all int, l_no int, "
               "p_o double, p_all double, p_no double")
ID = {x: i for i, x in enumerate(LABELS)}


def cands(spark, rows):
    """rows: (token, piece, label) with label always firing (overall best is that label)."""
    data = []
    for token, piece, label in rows:
        if label == "O":
            data.append((0, piece, token, f"w{token}", ID["O"], 0, 0.9, 0.9, 0.05))
        else:
            data.append((0, piece, token, f"w{token}", ID[label], ID[label], 0.1, 0.6, 0.6))
    return spark.createDataFrame(data, CAND_SCHEMA)


def labels_of(df):
    return [(r.token, r.label) for r in df.orderBy("token").collect()]


def test_repair_starting_i(spark):
    c = cands(spark, [(2, 1, "O"), (3, 2, "I-NAME_STUDENT"), (4, 3, "I-NAME_STUDENT")])
    for mode in (RewriteMode.REWRITE_STARTING_I, RewriteMode.REWRITE_BOTH):
        assert labels_of(decode(c, 0.0, mode)) == [(3, "B-NAME_STUDENT"), (4, "I-NAME_STUDENT")]
    assert labels_of(decode(c, 0.0, RewriteMode.NO_REWRITE)) == [(3, "I-NAME_STUDENT"), (4, "I-NAME_STUDENT")]


def test_repair_repeated_begin(spark):
    c = cands(spark, [(3, 1, "B-NAME_STUDENT"), (4, 2, "B-NAME_STUDENT")])
    assert labels_of(decode(c, 0.0, RewriteMode.REWRITE_BOTH)) == [(3, "B-NAME_STUDENT"), (4, "I-NAME_STUDENT")]
    for mode in (RewriteMode.NO_REWRITE, RewriteMode.REWRITE_STARTING_I):
        assert labels_of(decode(c, 0.0, mode)) == [(3, "B-NAME_STUDENT"), (4, "B-NAME_STUDENT")]


def test_first_piece_wins(spark):
    c = cands(spark, [(5, 1, "O"), (5, 2, "I-ID_NUM"), (5, 3, "B-EMAIL")])
    assert labels_of(decode(c, 0.0, RewriteMode.NO_REWRITE)) == [(5, "I-ID_NUM")]
    assert labels_of(decode(c, 0.0, RewriteMode.REWRITE_STARTING_I)) == [(5, "B-ID_NUM")]


def test_threshold_rule(spark):
    # Overall best is O (p_o = 0.4); best non-O is B-EMAIL: fires only when p_o < t.
    c = spark.createDataFrame([(0, 1, 0, "w", ID["O"], ID["B-EMAIL"], 0.4, 0.4, 0.3)], CAND_SCHEMA)
    got = {r.threshold: r.label for r in sweep_words(c, [0.0, 0.25, 0.5, 0.75]).collect()}
    assert got == {0.5: "B-EMAIL", 0.75: "B-EMAIL"}
    ids = {r.threshold: r.label_id for r in sweep_word_ids(c, [0.0, 0.5], with_score=True).collect()}
    assert ids == {0.5: ID["B-EMAIL"]}


def test_ignored_labels_are_dropped_before_repair(spark):
    c = cands(spark, [(1, 1, "B-EMAIL"), (2, 2, "I-NAME_STUDENT")])
    got = labels_of(decode(c, 0.0, RewriteMode.REWRITE_STARTING_I, ["B-EMAIL"]))
    assert got == [(2, "B-NAME_STUDENT")]


def _sequential_repair(rows, mode):
    """Restatement of the repair rule over emitted words in order."""
    out = []
    prev = None
    for token, label in rows:
        cont = prev is not None and prev[0] == token - 1 and prev[1][2:] == label[2:]
        new = label
        if mode >= 1 and label.startswith("I-") and not cont:
            new = "B-" + label[2:]
        elif mode == 2 and label.startswith("B-") and cont:
            new = "I-" + label[2:]
        out.append((token, new))
        prev = (token, new)
    return out


@pytest.mark.parametrize("mode", RewriteMode.ALL)
def test_repair_matches_sequential_rule(spark, mode):
    rng = random.Random(7 + mode)
    non_o = [x for x in LABELS if x != "O"][:4] + ["I-NAME_STUDENT", "B-NAME_STUDENT"]
    data, expected = [], []
    for doc in range(60):
        tokens = sorted(rng.sample(range(30), rng.randint(1, 12)))
        rows = [(t, rng.choice(non_o)) for t in tokens]
        data += [(0.5, doc, t, lab) for t, lab in rows]
        expected += [(doc, t, lab) for t, lab in _sequential_repair(rows, mode)]
    df = spark.createDataFrame(data, "threshold double, document long, token int, label string")
    got = sorted((r.document, r.token, r.label) for r in repair_bio(df, mode).collect())
    assert got == sorted(expected)


def test_id_chunking_equals_repair_then_chunking(spark):
    rng = random.Random(3)
    non_o = [x for x in LABELS if x != "O"]
    data = []
    for doc in range(80):
        for t in sorted(rng.sample(range(25), rng.randint(1, 15))):
            data.append((0.5, doc, t, rng.choice(non_o)))
    df = spark.createDataFrame(data, "threshold double, document long, token int, label string")
    with_ids = df.withColumn("label_id", F.array_position(F.array(*[F.lit(x) for x in LABELS]), F.col("label")).cast("int") - 1)
    from tessera.functions.bio import ENTITY_TYPES
    for mode in RewriteMode.ALL:
        a = sorted((r.document, r.entity_type, r.start, r.end)
                   for r in entity_spans(repair_bio(df, mode), keys=["threshold"]).collect())
        b = sorted((r.document, ENTITY_TYPES[r.type_id], r.start, r.end)
                   for r in entity_spans_ids(with_ids, keys=["threshold"], mode=mode).collect())
        assert a == b


def test_rule_model_collision(spark):
    cols = "document long, token int, label string, token_str string, score double"
    model = spark.createDataFrame([(0, 3, "B-USERNAME", "a@b.co", 0.7), (0, 4, "B-NAME_STUDENT", "x", 0.6)], cols)
    rules = spark.createDataFrame([(0, 3, "B-EMAIL", "a@b.co", 1.0)], cols)
    deduped = sorted((r.token, r.label) for r in rules_plus_model(model, rules).collect())
    assert deduped == [(3, "B-EMAIL"), (4, "B-NAME_STUDENT")]
    assert rules_plus_model(model, rules, dedupe=False).count() == 3
