"""Label lists decoded inside the documents' rows equal those of the word rows, and nothing but the texts is dealt."""

import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators.decode import decode, repair_bio_modes, sweep_words
from tessera.operators.entities import align_real_pred, label_sequences, label_sequences_sweep
from tessera.operators.scoring import HASHED_AT_ONCE, hash_keys, hash_logits
from tessera.operators.sequences import NAMES, repaired_documents
from tessera.plans.catalog import QUERIES
from tessera.plans.fixtures import Fixture
from tessera.schema import LABELS, RULE_LABELS, RewriteMode

TEXTS = ["", " ", "\n\n", "  a", "one two  three\nfour", "a@b.co (743) 555-3824 and more 1234567890123456", "\U0001d11e\U0001d11e\U0001d11e é über",
         None, "a " * 300, "(743) 555-3824 (743) 555-3824 ", "\x1c\x85 b", "some words that go on, and on; " * 20]
GRID = (0.0, 0.25, 0.75)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sequences")
    rows = [(i, t, "en", f"src{i % 4}", 0) for i, t in enumerate(TEXTS * 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        str(path / "documents.parquet"))
    return str(path)


def _same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


@pytest.mark.parametrize("records", [1, 7, 10_000])
def test_lists_of_the_grid_equal_those_of_word_rows(spark, folder, records):
    """However a document's pieces are cut into batches."""
    fx = Fixture(spark, folder)
    rows = repair_bio_modes(sweep_words(fx.fired(max(GRID)), GRID), RewriteMode.ALL)
    want = label_sequences_sweep(fx.real, rows, GRID, RewriteMode.ALL).collect()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        docs = repair_bio_modes(sweep_words(fx.told(max(GRID)), GRID), RewriteMode.ALL)
        got = label_sequences_sweep(None, docs, GRID, RewriteMode.ALL).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 9 * sum(bool(t) for t in TEXTS * 3)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)
    assert {x for r in got for x in r.labels_pred} > {"O", "I-EMAIL"}  # written by a repair alone


@pytest.mark.parametrize("ignored", [(), RULE_LABELS])
def test_lists_of_one_threshold_equal_those_of_word_rows(spark, folder, ignored):
    fx = Fixture(spark, folder)
    for mode in RewriteMode.ALL:
        want = label_sequences(align_real_pred(fx.real, decode(fx.fired(0.25), 0.25, mode, ignored)))
        assert _same(want, label_sequences(align_real_pred(None, decode(fx.told(0.25), 0.25, mode, ignored))))


def test_repair_inside_a_document_stops_at_its_ends(spark):
    ids = [NAMES.index(x) for x in ("B-EMAIL", "B-EMAIL", "O", "I-ID_NUM", "I-ID_NUM")]
    docs = spark.createDataFrame([(0, ids, ids), (1, [], []), (2, ids[4:], ids[4:])], "document long, real array<byte>, said0 array<byte>")
    got = {r.document: [[NAMES[i] for i in r[f"said{k}"]] for k in range(3)] for r in repaired_documents(docs.coalesce(1), RewriteMode.ALL).collect()}
    assert got[0] == [["B-EMAIL", "B-EMAIL", "O", "I-ID_NUM", "I-ID_NUM"], ["B-EMAIL", "B-EMAIL", "O", "B-ID_NUM", "I-ID_NUM"],
                      ["B-EMAIL", "I-EMAIL", "O", "B-ID_NUM", "I-ID_NUM"]]
    assert got[1] == [[], [], []] and got[2] == [["I-ID_NUM"], ["B-ID_NUM"], ["B-ID_NUM"]] and NAMES[:13] == LABELS


@pytest.mark.parametrize("name", ["label_sequences_sweep", "label_sequences"])
def test_the_texts_alone_are_dealt(spark, folder, name):
    """Neither pieces nor words are shuffled, sorted, joined, grouped or cached."""
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Scan parquet") == 1
    for step in ("Sort", "Join", "Aggregate", "Window", "InMemoryTableScan"):
        assert step not in plan, step


def test_pieces_without_a_head_raise(spark, folder):
    lost = Fixture(spark, folder).told(0.75).where(F.col("labels").isNull())
    with pytest.raises(Exception, match="without its head"):
        sweep_words(lost, GRID).collect()


def test_hashes_of_keys_equal_md5():
    """Keys of one block and longer ones, in any batch."""
    keys = [f"{7919 * i}:{i % 500 - 1}:{i}" for i in range(HASHED_AT_ONCE + 9)] + ["", "x" * 55, "x" * 56, "ü" * 90]
    for at in (0, 5, HASHED_AT_ONCE, len(keys) - 1, len(keys)):
        a, b = hash_keys(pa.array(keys, pa.string()).slice(at))
        raw = [hashlib.md5(k.encode()).digest() for k in keys[at:]]
        assert a.tolist() == [int.from_bytes(r[:7], "big") for r in raw] and b.tolist() == [int.from_bytes(r[7:13], "big") for r in raw]


@pytest.mark.parametrize("salt", [None, "b"])
def test_pieces_bring_the_hash_along(spark, folder, salt):
    """The same logits as by hashing the pieces' rows, without a string for each piece."""
    fx = Fixture(spark, folder)
    brought = hash_logits(fx.cut((), by_id=True, salts=(salt,)), "word_label_id", salt=salt)
    assert _same(hash_logits(fx.cut((), by_id=True), "word_label_id", salt=salt), brought)
    for name in ("label_sequences", "softmax_scores", "ensemble_scores"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "md5(" not in plan and "ArrowEvalPython" not in plan, name
