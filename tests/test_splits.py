import hashlib

import pytest

from tessera.operators.splits import holdout_split, kfold_split, seeded_shuffle, split_by_fold


def _docs(spark, n):
    return spark.range(n).selectExpr("id * 7 + 3 AS document")


@pytest.mark.parametrize("n,k", [(1000, 5), (23, 5), (3, 5), (101, 10)])
def test_kfold_sizes_and_partition(spark, n, k):
    folds = kfold_split(_docs(spark, n), k, 42).collect()
    assert sorted(r.document for r in folds) == [i * 7 + 3 for i in range(n)]
    sizes = [sum(1 for r in folds if r.fold == f) for f in range(k)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == n
    assert sizes == sorted(sizes, reverse=True)


def test_seeded_order_is_md5_order(spark):
    got = [r.document for r in seeded_shuffle(_docs(spark, 200), 42).orderBy("position").collect()]
    want = sorted((i * 7 + 3 for i in range(200)), key=lambda d: (hashlib.md5(f"42:{d}".encode()).hexdigest(), d))
    assert got == want


def test_holdout_fraction(spark):
    s = holdout_split(_docs(spark, 101), 0.2, 42).collect()
    assert sum(1 for r in s if r.split == "test") == 21


def test_fold_out_of_range_raises(spark):
    with pytest.raises(ValueError):
        split_by_fold(_docs(spark, 10), 5, 5, 42)
