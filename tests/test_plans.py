"""Whole-pipeline checks on the smallest driver table set (sf0.001)."""

import gc
import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL
from tessera.operators.calibrate import calibrate
from tessera.operators.decode import decode_sweep
from tessera.operators.entities import count_matches, entity_match, entity_spans
from tessera.operators.calibrate import per_threshold
from tessera.operators import labels
from tessera.operators.labels import class_encode, join_encode, label_encode, label_vocab
from tessera.operators.scoring import hash_logits, live_logits, softmax_scores, with_argmax
from tessera.operators.splits import RANGE_BUCKETS, positions, range_bucket
from tessera.operators.tokens import corpus_words, document_words
from tessera.plans import fixtures
from tessera.plans.catalog import QUERIES
from tessera.plans.fixtures import Fixture
from tessera.plans.oracle_catalog import ORACLE
from tessera.schema import LOGIT_COLS, O_ID, THRESHOLDS, RewriteMode
from tessera.session import deal_finely
from tessera.sources.corpus import corpus_project, corpus_union, load_corpus_json, renumber


@pytest.fixture(scope="module")
def fx(spark):
    return Fixture(spark, SF_SMALL)


def _dense_calibration(fx, mode):
    """The same metric by the string path: decode every threshold, chunk, outer-match."""
    preds = decode_sweep(fx.cands, THRESHOLDS, mode)
    pe = entity_spans(preds, keys=["threshold"])
    te = per_threshold(entity_spans(fx.silver), THRESHOLDS)
    c = count_matches(entity_match(pe, te, keys=["threshold"]), ["threshold"])
    return {r.threshold: (r.tp, r.n_pred, r.n_true) for r in c.collect()}


@pytest.mark.parametrize("mode", RewriteMode.ALL)
def test_sweep_equals_dense_path(fx, mode):
    fast = {r.threshold: (r.tp, r.n_pred, r.n_true) for r in calibrate(fx.live(max(THRESHOLDS), False), fx.silver, mode=mode).collect()}
    assert fast == _dense_calibration(fx, mode)


def test_modes_0_and_1_score_alike(fx):
    a = calibrate(fx.live(max(THRESHOLDS), False), fx.silver, mode=0).orderBy("threshold").collect()
    b = calibrate(fx.live(max(THRESHOLDS), False), fx.silver, mode=1).orderBy("threshold").collect()
    assert [(r.tp, r.n_pred, r.f5) for r in a] == [(r.tp, r.n_pred, r.f5) for r in b]


def test_entry_smoke(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == len(THRESHOLDS)
    assert set(ORACLE) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_building_a_query_reads_schemas_only(spark):
    """One job at most: the footer read of the table."""
    sc = spark.sparkContext
    for name, q in QUERIES.items():
        sc.setJobGroup(f"build-{name}", name)
        df = q(spark, SF_SMALL)
        assert df.columns, name
        assert len(sc.statusTracker().getJobIdsForGroup(f"build-{name}")) <= 1, name
    sc.setJobGroup("tests", "tests")


def test_no_fixed_partition_count(spark):
    for name, q in QUERIES.items():
        assert "REPARTITION_BY_NUM" not in _plan(q(spark, SF_SMALL)), name


def test_sparse_ids_need_few_buckets(spark):
    ids = spark.range(3000).select((F.col("id") * 10**14 - 10**17).alias("document"))
    buckets = ids.select(range_bucket(ids, F.col("document")).alias("b"))
    assert buckets.where(f"b < 0 or b >= {RANGE_BUCKETS}").isEmpty()
    got = positions(ids, F.col("document"), range_bucket(ids, F.col("document")))
    assert got.where("document <> position * 100000000000000 - 100000000000000000 or n <> 3000").isEmpty()
    assert got.count() == 3000


def test_renumber_and_union(spark):
    c = spark.createDataFrame([(7, "a"), (900_000_000_000, "b"), (3, "c")], "document long, t string")
    got = {r.t: r.document for r in renumber(c, 50).collect()}
    assert got == {"c": 50, "a": 51, "b": 52}
    assert renumber(c, 0) is c
    both = corpus_union([c, c.select("t", F.col("document").cast("int"))])
    assert both.columns == ["document", "t"] and both.count() == 6


def test_json_corpus(spark, tmp_path):
    rec = {"document": 4, "full_text": "a b", "tokens": ["a", "b"], "trailing_whitespace": [True, False],
           "labels": ["O", "B-EMAIL"]}
    (tmp_path / "array.json").write_text(json.dumps([rec, rec | {"document": 5, "labels": None}]))
    (tmp_path / "lines.jsonl").write_text(json.dumps(rec) + "\n" + json.dumps(rec | {"document": 5, "labels": None}))
    for name, lines in (("array.json", False), ("lines.jsonl", True)):
        c = corpus_project(load_corpus_json(spark, str(tmp_path / name), lines)).orderBy("document").collect()
        assert [(r.document, r.tokens, r.provided_labels) for r in c] == [
            (4, ["a", "b"], ["O", "B-EMAIL"]), (5, ["a", "b"], None)]
    words = corpus_words(corpus_project(load_corpus_json(spark, str(tmp_path / "array.json"))), with_labels=True)
    assert [(r.token, r.word, r.trailing_whitespace, r.label, r.n_words)
            for r in words.where("document = 4").orderBy("token").collect()] == [
        (0, "a", True, "O", 2), (1, "b", False, "B-EMAIL", 2)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_partition_exchange(fx):
    for df in (calibrate(fx.live(max(THRESHOLDS), False), fx.silver, mode=2), decode_sweep(fx.cands, THRESHOLDS, 1)):
        assert "SinglePartition" not in _plan(df)


def test_scan_prunes_columns(spark):
    df = entry.queries()["kfold_split"](spark, SF_SMALL)
    plan = _plan(df)
    assert "ReadSchema: struct<doc_id:bigint>" in plan or "struct<doc_id:bigint>" in plan


def test_pieces_that_cannot_fire_are_dropped_below_the_alignment(spark, fx):
    """The test on logits stands under the window that aligns and sorts; it drops most pieces."""
    lines = _plan(fx.live(0.25)).splitlines()
    window = next(i for i, line in enumerate(lines) if "Window [last(" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-|*()0123456789"))
    below = [line for line in lines[window + 1:] if depth(line) > depth(lines[window])]
    assert any("Filter" in line and "EXP(" in line for line in below)
    every, live = fx.cands.count(), fx.live(0.25).count()
    fires = fx.cands.where(f"l_all <> {O_ID} or p_o < 0.25").count()
    assert fires == live < every / 2


@pytest.mark.parametrize("threshold", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_live_pieces_are_those_that_can_fire(spark, threshold):
    rng = random.Random(3)
    rows = [[rng.choice([0.0, 1.0, 2.0, 5.0, -3.0, 600.0, -700.0]) + rng.choice([0.0, rng.random()]) for _ in range(13)] for _ in range(3000)]
    z = spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], "document long, piece int, " + ", ".join(f"{c} double" for c in LOGIT_COLS))
    scored = with_argmax(softmax_scores(z)).where(f"l_all <> {O_ID} or p_o < {threshold}")
    kept = {r.piece for r in live_logits(z, threshold).collect()}
    fires = {r.piece for r in scored.collect()}
    assert fires <= kept and len(kept - fires) <= 3 + (threshold == 1.0) * len(rows)


def test_codes_need_no_exchange_by_label(spark):
    rows = spark.createDataFrame([(i, "O" if i % 3 else f"L{i % 5}") for i in range(50)] + [(99, None)], "document long, label string")
    vocab = label_vocab(rows)
    got = label_encode(rows, vocab)
    assert "Join" not in _plan(got)
    codes = {r.label: r.label_id for r in vocab.collect()}
    assert all(r.label_id == codes.get(r.label) for r in got.collect()) and got.count() == 51
    with pytest.raises(Exception, match="unknown label: L"):
        label_encode(rows, vocab.where("label = 'O'")).collect()
    both = class_encode(rows, "label").join(join_encode(rows, "label").withColumnRenamed("label_code", "other"), "document")
    assert "Join" not in _plan(class_encode(rows, "label")) and both.where("not label_code <=> other").isEmpty()


def test_too_large_a_vocabulary_raises(spark, monkeypatch):
    monkeypatch.setattr(labels, "DICTIONARY_MAX", 3)
    rows = spark.createDataFrame([(i, f"L{i}") for i in range(5)], "document long, label string")
    with pytest.raises(Exception, match="too large for a dictionary: 5"):
        class_encode(rows, "label").collect()


def test_cached_tables_belong_to_their_query(spark):
    a = QUERIES["label_encode"](spark, SF_SMALL)
    cached = lambda: "InMemoryTableScan" in _plan(a.select("*"))
    assert cached()
    b = QUERIES["detect_rules"](spark, SF_SMALL)
    c = QUERIES["label_encode"](spark, SF_SMALL)
    assert cached()
    del b, c
    gc.collect()
    assert cached() and a.count() > 0
    del a
    gc.collect()
    assert not fixtures._readers


def test_queries_leave_the_callers_session_alone(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    own.conf.set("spark.sql.shuffle.partitions", "3")
    df = QUERIES["kfold_split"](own, SF_SMALL)
    assert own.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert df.sparkSession.conf.get("spark.sql.shuffle.partitions") == "3"
    assert df.sparkSession.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "false" and df.count() == 200


def test_training_set_plan_is_small(spark):
    plan = _plan(QUERIES["training_set"](spark, SF_SMALL))
    outer, hidden = 0, None
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-|"))
        if hidden is not None and depth > hidden:
            continue
        hidden = depth if "InMemoryRelation" in line else None
        outer += "Exchange" in line
    assert outer < 20


def test_generators_read_stored_columns_and_nothing_is_computed_twice(spark, fx):
    """An expression inside a generator is interpreted; a plain generator has its array computed again in a filter."""
    assert _plan(document_words(fx.scanned)).count("regexp_extract_all(") == 1
    pieces = _plan(fx.pieces)
    assert "Generate explode(concat(" not in pieces and "Generate inline(array(" not in _plan(hash_logits(fx.pieces))
    assert _plan(hash_logits(fx.pieces)).count("md5(") == 1


def test_words_read_once_are_not_cached(spark):
    cached = lambda name: [t for t in _cached_by(spark, name) if "word" in t]
    assert not cached("label_vocab") and not cached("softmax_scores") and len(cached("label_encode")) == 1


def _cached_by(spark, name):
    token = fixtures._building.set([])
    try:
        QUERIES[name].__wrapped__(spark, SF_SMALL)
        return [df.columns for df in fixtures._building.get()]
    finally:
        for df in fixtures._building.get():
            df.unpersist()
        fixtures._building.reset(token)


def test_partitions_follow_the_input(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "3")
    number = lambda: own.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")
    deal_finely(own, 1000)
    assert number() == "3"
    deal_finely(own, 6 << 30)
    assert int(number()) >= 3000 and own.conf.get("spark.sql.shuffle.partitions") == "3"


def test_decoded_words_are_dealt_once(fx):
    """Neither the first firing piece of a word nor the repair or the chunks of a document's words shuffle again."""
    cands = fx.fired(max(THRESHOLDS), with_token_str=False)
    for df in (decode_sweep(fx.fired(max(THRESHOLDS)), THRESHOLDS, RewriteMode.REWRITE_BOTH),
               calibrate(cands, cands.selectExpr("document", "token", "l_no as label_id"))):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        above = lines[:next(i for i, x in enumerate(lines) if "ArrowEvalPython" in x)]
        dealt = [x for x in above if "Exchange hashpartitioning(document#" in x or "Exchange hashpartitioning(threshold#" in x and "document#" in x]
        assert len(dealt) == 1
