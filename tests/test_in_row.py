"""Spans, pieces and alignment inside a document's row equal the row-by-row operators, on odd texts."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.bio import label_id
from tessera.operators.entities import align_real_pred_sweep, label_sequences, label_sequences_sweep
from tessera.operators.labels import silver_labels
from tessera.operators.pieces import align_pieces, cut_pieces, labelled_pieces
from tessera.operators.rules import detect_phones, detect_rules
from tessera.operators.tokens import document_words, with_char_spans
from tessera.plans.fixtures import Fixture

TEXTS = ["", " ", "\n\n", " ", "  a", "one two  three\nfour", "x", "a@b.co (743) 555-3824 and more 1234567890123456",
         "\U0001d11e\U0001d11e\U0001d11e\U0001d11e\U0001d11e é über", None, "a " * 50, "(743) 555-3824 (743) 555-3824 ", "\x1c\x85 b"]


@pytest.fixture(scope="module")
def fx(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, t, "en", f"src{i}", 0) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        str(folder / "documents.parquet"))
    return Fixture(spark, str(folder))


@pytest.fixture(scope="module")
def words(fx):
    return silver_labels(with_char_spans(document_words(fx.docs)), fx.phones)


def _same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


def test_words_equal_those_of_the_window(fx, words):
    assert words.count() > 80 and _same(words, fx.silver)
    assert fx.silver.where("label like '%PHONE%'").count() > 5


def test_pieces_alignment_and_labels_equal_the_operators(fx, words):
    pieces = cut_pieces(words.withColumnRenamed("label", "word_label"), carry=("word_label",))
    assert _same(pieces, fx.pieces)
    aligned = align_pieces(pieces, words).select("document", "piece", "token", "token_str", "start", "end")
    got = fx.cut(("start", "end", "at", "at_match")).where("at >= 0").select(
        "document", "piece", F.col("at").alias("token"), "token_str", "start", "end")
    assert _same(aligned, got)
    labelled = labelled_pieces(pieces, words).select("document", "piece", label_id(F.col("label")).alias("label_id"))
    assert _same(labelled, fx.piece_labels)


def test_pieces_need_no_sort(fx):
    for df in (fx.pieces, fx.fired(0.75), fx.labelled_logits):
        plan = df._jdf.queryExecution().executedPlan().toString()
        below_the_phones = plan[:plan.index("SortMergeJoin")] if "SortMergeJoin" in plan else plan
        assert "Window" not in below_the_phones and "Sort [" not in below_the_phones


def test_labels_of_other_words_are_looked_up(spark):
    """A piece that starts on white space before a word takes that word's label, here that of another word."""
    from tessera.operators.in_row import PIECE_FIELDS, WORD_FIELDS, word_rows

    docs = spark.createDataFrame([(0, ["a ", " ", "bcde "])], "document long, _ms array<string>")
    rows = docs.select(F.inline(word_rows(F.col("_ms"), None, tuple(WORD_FIELDS), tuple(PIECE_FIELDS)))).collect()
    assert [(r.match, r.blank, r.space, r.char_start, r.char_end) for r in rows] == [
        ("a ", False, True, 0, 1), (" ", True, False, 2, 3), ("bcde ", False, True, 3, 7)]
    pieces = [p for r in rows for p in r.pieces]
    assert [(p.piece, p.own, p.start, p.end, p.at, p.labelled_by) for p in pieces] == [
        (0, -1, 0, 0, -1, -1), (1, 0, 0, 1, 0, 0), (2, 2, 2, 7, 2, 2), (3, -1, 0, 0, -1, -1)]


def test_label_lists_of_the_grid_are_gathered_once(spark):
    """One list a document, not one for each cell; equal to the lists of every cell gathered alone."""
    real = spark.createDataFrame([(d, t, f"w{t}", "B-EMAIL" if t == 1 else "O") for d in (0, 1) for t in range(11)],
                                 "document long, token int, token_value string, label string")
    preds = spark.createDataFrame([(m, th, 0, t, f"L{m}{th}{t}", "x", 0.5) for m in (0, 1) for th in (0.0, 0.5) for t in (1, 10, 12)],
                                  "mode int, threshold double, document long, token int, label string, token_str string, score double")
    args = (real, preds, [0.0, 0.5], [0, 1])
    got = label_sequences_sweep(*args)
    alone = label_sequences(align_real_pred_sweep(*args), ("mode", "threshold"))
    assert got.count() == 8 and _same(got, alone)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [document#" in plan and "Aggregate [mode#" not in plan


def test_span_search_reads_the_documents_with_hits_alone(fx):
    """The words of other documents are never cut for it, and what it finds is what it finds among all words."""
    assert {r.document for r in fx.hit_words.select("document").collect()} == {7, 11}
    assert fx.hit_words.count() < fx.raw_words.count()
    assert _same(fx.phones, detect_phones(fx.scanned, fx.raw_words))
    assert _same(fx.rules, detect_rules(fx.scanned, fx.raw_words))
    plan = fx.phones._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == plan.count("RLIKE") > 0


def test_phones_are_found_inside_the_documents_row(spark, tmp_path):
    """Overlapping, repeated and partial hits, as the search by rolling hash finds them; no join, window or cached table."""
    from tessera.plans.catalog import QUERIES

    texts = ["(743) 555-3824 x (743) 555-3824 ", "(743) 555-3824 (743)", "743.555.3824 (743)555-3824a 743.555.3824\n", "( 743 ) 555-3824", "(743) 555-3824x (743) 555-3824 ",
             "", None, "a@b.co 1.743.555.3824 743.555.3824 1234567890123456", "(743)  555-3824 (743) 555-3824\n(743) 555-3824 b"] * 3
    rows = [(i, t, "en", "src0", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        str(tmp_path / "documents.parquet"))
    fx = Fixture(spark, str(tmp_path))
    found = fx.silver.where("label like '%PHONE%'").select("document", "token", "label", F.col("word").alias("token_str"))
    rules = fx.phones.where(~F.col("token_str").contains("@"))
    assert found.count() > 40 and _same(found, rules)
    for name in ("argmax_label", "ensemble_scores", "decode_ignored", "piece_metrics", "label_vocab"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Scan parquet") == 1 and "Join" not in plan and "InMemoryTableScan" not in plan, name


def test_pieces_without_a_label_are_not_dealt(spark):
    """Numbers without gaps serve as they are: same metrics, and the pieces that are O on both sides are dropped below the shuffle."""
    from tessera.operators.entities import piece_metrics_labelled

    rows = [(d, p, (7 * d + 5 * p) % 13 if p % 3 else 12, (d + p * p) % 13 if p % 4 else 12) for d in range(9) for p in range(1, 40)]
    rows += [(d, p, 3, -100) for d in range(9) for p in (0, 40)]
    df = spark.createDataFrame(rows, "document long, piece int, _pred int, label_id int")
    fast = piece_metrics_labelled(df, gapless=True)
    assert _same(piece_metrics_labelled(df), fast) and fast.where("tp > 0").count() > 1
    lines = fast._jdf.queryExecution().optimizedPlan().toString().split("\n")
    dealt = next(i for i, x in enumerate(lines) if "RepartitionByExpression [document" in x)
    assert any("Filter" in x or "LocalRelation" in x for x in lines[dealt:]) and not any("Window [row_number" in x for x in lines)
