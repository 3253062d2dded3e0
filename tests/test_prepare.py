"""Training sets against plain Python, and the check that document ids are unique."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tessera.operators.prepare import (TrainingSet, cut_counts, example_pieces, loaded_ids, planned_examples, positive_rows,
                                       training_plan, truncate_left)
from tessera.operators.splits import holdout_split, kfold_split, seeded_positions

SIZES = {0: 53, 1: 17, 2: 9, 3: 25}


def _members():
    """Ids with gaps, interleaved over the corpora."""
    rows, at = [], 3
    left = dict(SIZES)
    while any(left.values()):
        for c in left:
            if left[c]:
                left[c] -= 1
                rows.append((c, at))
                at += 1 + (at % 5)
    return rows


def _words(members):
    """Documents of 0 to 11 words; target words at some places."""
    out = []
    for c, d in members:
        n = d % 12
        out += [(d, i, f"w{(d + i) % 7}", i % 2 == 0, n, "B-EMAIL" if (d * 7 + i) % 9 == 0 else "O") for i in range(n)]
    return out


def _frames(spark):
    members = _members()
    words = spark.createDataFrame(_words(members), "document long, token int, word string, trailing_whitespace boolean, n_words int, label string")
    return spark.createDataFrame(members, "corpus int, document long"), words


def _order(seed, ids):
    return sorted(ids, key=lambda d: (hashlib.md5(f"{seed}:{d}".encode()).hexdigest(), d))


def _fold(ids, k, seed):
    order, out, at = _order(seed, ids), {}, 0
    for f in range(k):
        size = len(order) // k + (f < len(order) % k)
        out.update((d, f) for d in order[at:at + size])
        at += size
    return out


def _brute(s):
    members, words = _members(), _words(_members())
    by = {d: [w for w in words if w[0] == d] for _, d in members}
    ids = {c: sorted(d for k, d in members if k == c) for c in SIZES}
    for c, n in s.heads:
        ids[c] = ids[c][:len(ids[c]) // n]
    at, renamed = max(ids[0]) + 1, {}
    for c in (1, 2, 3):
        renamed[c] = [(d, at + i) for i, d in enumerate(ids[c])]
        at += len(ids[c])
    outer = _fold(ids[0], s.outer[0], s.outer[2])
    rest = [d for d in ids[0] if outer[d] != s.outer[1]]
    inner = _fold(rest, s.inner[0], s.inner[2])

    def row(split, origin, d, new, cut):
        kept = by[d][max(len(by[d]) - s.keep_last, 0):] if cut else by[d]
        targets = sum(w[5] != "O" for w in kept)
        return split, origin, d, new, cut, len(kept), targets, int(targets > 0)

    cuts = s.keep_last is not None
    rows = [row("val", "val", d, d, cuts) for d in rest if inner[d] == s.inner[1]]
    for d in rest:
        if inner[d] != s.inner[1]:
            copies = [row("train", "base_full", d, d, False)] if s.double or not cuts else []
            copies += [row("train", "base_cut", d, d + at, True)] if cuts else []
            rows += [r for r in copies if r[7] or not s.positives_only]
    rows += [row("train", "extra", d, new, cuts) for c in s.extras for d, new in renamed[c]]
    place = {(split, d): i for split in ("train", "val") for i, d in enumerate(_order(s.seed, [r[3] for r in rows if r[0] == split]))}
    return sorted((*r, place[r[0], r[3]]) for r in rows)


COLUMNS = ("split", "origin", "source_document", "document", "cut", "n_words", "target_num", "group", "position")


@pytest.mark.parametrize("settings", [
    TrainingSet(keep_last=6, heads=((3, 10),)),
    TrainingSet(extras=(1, 2, 3), keep_last=6, double=False, positives_only=False),
    TrainingSet(extras=(), keep_last=None, double=False, heads=(), outer=(4, 0, 5), inner=(3, 2, 9)),
    TrainingSet(extras=(3,), keep_last=2, heads=((2, 50), (3, 2)), seed=1),
])
def test_plan_by_brute_force(spark, settings):
    members, words = _frames(spark)
    plan = training_plan(members, cut_counts(words, settings.keep_last), settings)
    assert sorted(tuple(r[c] for c in COLUMNS) for r in plan.collect()) == _brute(settings)


def test_examples_are_those_of_the_planned_documents(spark):
    members, words = _frames(spark)
    s = TrainingSet(keep_last=6, max_length=9)
    got = {r.document: r for r in planned_examples(words, training_plan(members, cut_counts(words, 6), s), s).collect()}
    full = {r.document: r.pieces for r in example_pieces(words, 9).collect()}
    cut = {r.document: r.pieces for r in example_pieces(truncate_left(words, 6), 9).collect()}
    brute = {r[3]: r for r in _brute(s) if r[5]}
    assert set(got) == set(brute) and max(r.length for r in got.values()) == 9
    for d, r in got.items():
        assert r.pieces == (cut if brute[d][4] else full)[r.source_document] and r.length == len(r.pieces)


def test_settings_are_checked():
    for bad in ({"keep_last": None}, {"extras": (0, 1)}, {"inner": (5, 5, 1)}):
        with pytest.raises(ValueError):
            TrainingSet(**bad)


def test_duplicate_ids_raise_when_the_query_runs(spark):
    sc = spark.sparkContext
    docs = spark.createDataFrame([(1,), (2,), (3,), (2,)], "document long")
    sc.setJobGroup("duplicates", "duplicates")
    folds = [kfold_split(docs, 2, 42), holdout_split(docs), loaded_ids(docs.withColumn("corpus", F.lit(0)), TrainingSet())]
    assert not sc.statusTracker().getJobIdsForGroup("duplicates")
    sc.setJobGroup("tests", "tests")
    for df in folds:
        with pytest.raises(Exception, match="more than once: 2"):
            df.collect()
        with pytest.raises(Exception, match="more than once: 2"):
            df.select("document").collect()
    assert seeded_positions(docs, 1, unique=False).count() == 3
    # The same id in two corpora is two documents.
    both = spark.createDataFrame([(0, 1), (1, 1), (1, 2)], "corpus int, document long")
    assert sorted((r.corpus, r.document) for r in loaded_ids(both, TrainingSet(heads=())).collect()) == [(0, 1), (1, 2), (1, 3)]


def test_rows_of_positive_documents(spark):
    _, words = _frames(spark)
    got = positive_rows(words.withColumn("extra", F.lit(1)))
    assert got.columns == [*words.columns, "extra"]
    have = {w[0] for w in _words(_members()) if w[5] != "O"}
    assert sorted((r.document, r.token) for r in got.collect()) == sorted((w[0], w[1]) for w in _words(_members()) if w[0] in have)
