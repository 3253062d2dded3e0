"""Training examples made inside the documents' rows equal those of word rows, and no word or piece is dealt, sorted or cached."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.prepare import (TrainingSet, cut_counts, plan_by_source, planned_examples, training_examples, training_plan,
                                       truncate_left)
from tessera.plans.catalog import QUERIES
from tessera.plans.fixtures import Fixture

TEXTS = ["", " ", "\n\n", "  a", "one two  three\nfour", "a@b.co (743) 555-3824 and more 1234567890123456", "\U0001d11e\U0001d11e\U0001d11e é über",
         None, "a " * 60, "x (743) 555-3824 (743) 555-3824 ", "\x1c\x85 b", "some words that go on, and on; " * 9, "  " * 5, "a  b\n\nc@d.ef  \n"]


@pytest.fixture(scope="module")
def fx(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("examples")
    rows = [(3 * i, t, "en", f"src{i % 4}", 0) for i, t in enumerate(TEXTS * 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(
        str(path / "documents.parquet"))
    return Fixture(spark, str(path))


def _same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.select(*a.columns).collect()), key=repr)


@pytest.mark.parametrize("keep_last", [1, 3, 4, 50, 1750])
@pytest.mark.parametrize("max_length", [3, 9, 1750])
def test_examples_equal_those_of_word_rows(fx, keep_last, max_length):
    """Cuts may fall inside a phone number, whose words keep the labels that they had in the whole text."""
    want = training_examples(truncate_left(fx.silver, keep_last), max_length)
    got = training_examples(truncate_left(fx.lettered, keep_last), max_length)
    assert got.dtypes == want.dtypes and got.count() == 5 * sum(bool(t) for t in TEXTS) and _same(want, got)


def test_examples_without_a_left_cut(fx):
    assert _same(training_examples(fx.silver, 20), training_examples(fx.lettered, 20))


@pytest.mark.parametrize("keep_last", [None, 2, 1750])
def test_counts_equal_those_of_word_rows(fx, keep_last):
    want, got = cut_counts(fx.silver, keep_last), cut_counts(fx.lettered, keep_last)
    assert got.dtypes == want.dtypes and _same(want, got)


@pytest.mark.parametrize("settings", [
    TrainingSet(keep_last=4, max_length=9),
    TrainingSet(extras=(1, 2, 3), keep_last=3, double=False, positives_only=False, heads=()),
    TrainingSet(extras=(), keep_last=None, double=False, heads=(), max_length=20),
])
def test_planned_examples_equal_those_of_word_rows(fx, settings):
    plan = training_plan(fx.doc_sources.select("corpus", "document"), cut_counts(fx.lettered, settings.keep_last), settings)
    want = planned_examples(fx.silver, plan, settings)
    got = planned_examples(fx.lettered_for(plan_by_source(plan)), None, settings)
    assert dict(got.dtypes) == dict(want.dtypes) and want.count() >= 5 and _same(want, got)


def test_a_document_is_joined_once_whatever_examples_it_gives(fx):
    plan = training_plan(fx.doc_sources.select("corpus", "document"), cut_counts(fx.lettered), TrainingSet(positives_only=False))
    by = plan_by_source(plan).select("document", F.size("_plan").alias("n")).collect()
    assert {r.n for r in by} == {1, 2} and len({r.document for r in by}) == len(by)


@pytest.mark.parametrize("name", ["training_set", "training_set_all_corpora", "training_examples"])
def test_words_and_pieces_stay_in_their_rows(fx, name):
    """What is shuffled or cached holds texts or ids alone: no word, piece or label."""
    lines = QUERIES[name](fx.spark, fx.sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    dealt = [x for x in lines if "RepartitionByExpression" in x]
    assert dealt and not any("Explode" in x or "explode(" in x or "_ws" in x for x in lines)
    if name == "training_examples":
        plan = QUERIES[name](fx.spark, fx.sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and not any(x in plan for x in ("Sort", "Join", "Aggregate", "Window", "InMemoryTableScan"))
