"""Document-level splits: seeded K-fold, nested folds, hold-out, seeded shuffle.

All of them need each document's position in a seeded pseudo-random order. A single
``row_number() over (order by ...)`` would pull every row into one task, so positions are
computed in two levels: documents fall into buckets by a hash prefix (the order key's own
leading digits, so bucket order is key order), a small table of bucket counts gives each
bucket its offset, and ``row_number`` runs inside buckets only. Groups stay ~N/buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import (EVAL_FOLD, EVAL_FOLDS, EVAL_SEED, INNER_FOLD, INNER_FOLDS, INNER_SEED, OUTER_FOLD,
                      OUTER_FOLDS, OUTER_SEED)

# Hex digits of the hash used as bucket: 16^5 (about one million) buckets at most, so the
# bucket table is bounded whatever the corpus size.
BUCKET_HEX = 5
# Buckets that the range of a numeric key is cut into, dense or sparse.
RANGE_BUCKETS = 1 << 16


def shuffle_key(seed: int, document: Column | None = None) -> Column:
    """The seeded order key of a document: ``md5('<seed>:<document>')`` (hex)."""
    doc = document if document is not None else F.col("document")
    return F.md5(F.concat(F.lit(f"{seed}:"), doc.cast("string")))


def positions(df: DataFrame, key: Column, bucket: Column, tiebreak: str = "document",
              group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Add ``position`` (0-based rank by ``key, tiebreak`` within ``group_cols``) and ``n``
    (group size). ``bucket`` must be monotone in ``key``."""
    g = list(group_cols)
    x = df.withColumn("_key", key).withColumn("_bucket", bucket)
    counts = x.groupBy(*g, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    # Over the bucket table only (one row per non-empty bucket).
    before = Window.partitionBy(*g).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    offsets = counts.select(
        *g, "_bucket",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_offset"),
        F.sum("_cnt").over(whole).alias("n"),
    )
    inner = Window.partitionBy(*g, "_bucket").orderBy("_key", tiebreak)
    ranked = x.withColumn("_rn", F.row_number().over(inner))
    return ranked.join(offsets, [*g, "_bucket"], "inner").withColumn(
        "position", (F.col("_offset") + F.col("_rn") - 1).cast("long")
    ).drop("_key", "_bucket", "_rn", "_offset")


def range_bucket(df: DataFrame, key: Column) -> Column:
    """Bucket of a numeric ``key`` for :func:`positions`: its range in ``df`` cut into
    ``RANGE_BUCKETS`` equal parts, so the bucket table is bounded however sparse the ids are.
    The range is a scalar subquery: nothing runs before the query does."""
    low, high = F.min(key).cast("double"), F.max(key).cast("double")
    width = F.greatest((high - low + 1) / RANGE_BUCKETS, F.lit(1.0))
    cut = df.agg(F.struct(low.alias("low"), width.alias("width")).alias("cut")).scalar()
    return F.least(F.floor((key.cast("double") - cut["low"]) / cut["width"]), F.lit(RANGE_BUCKETS - 1))


def unique_documents(docs: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """The documents, one row each; an id that occurs more than once raises when the query runs.

    The check is part of the plan: the rows are grouped by id and the id itself is what raises, so no
    consumer can read past it and nothing runs while a query is built.
    """
    counted = docs.groupBy(*group_cols, "document").agg(F.count(F.lit(1)).alias("_times"))
    twice = F.raise_error(F.concat(F.lit("document id occurs more than once: "), F.col("document").cast("string")))
    return counted.select(*group_cols, F.when(F.col("_times") == 1, F.col("document")).otherwise(twice).alias("document"))


def seeded_positions(docs: DataFrame, seed: int, group_cols: tuple[str, ...] = (), unique: bool = True) -> DataFrame:
    """Position of every document in the seeded shuffle order. Ids must be unique (checked when the
    query runs); with ``unique=False`` repeated ids, such as those of word rows, count once."""
    ids = unique_documents(docs, group_cols) if unique else docs.select(*group_cols, "document").distinct()
    key = shuffle_key(seed)
    return positions(ids, key, F.substring(key, 1, BUCKET_HEX), group_cols=group_cols)


def fold_of(position: Column, n: Column, k: int) -> Column:
    """``ntile``-style fold: the first ``n % k`` folds hold one document more."""
    q = F.floor(n / k)
    r = n % k
    big = (q + 1) * r
    return F.when(position < big, F.floor(position / (q + 1))).otherwise(
        r + F.floor((position - big) / F.greatest(q, F.lit(1)))).cast("int")


def kfold_split(docs: DataFrame, num_folds: int = EVAL_FOLDS, seed: int = EVAL_SEED,
                group_cols: tuple[str, ...] = (), unique: bool = True) -> DataFrame:
    """``(document, fold)``: seeded, shuffled K-fold over documents, whose ids must be unique."""
    if num_folds < 2:
        raise ValueError("num_folds must be at least 2")
    p = seeded_positions(docs, seed, group_cols, unique)
    return p.select(*group_cols, "document", fold_of(F.col("position"), F.col("n"), num_folds).alias("fold"))


def split_by_fold(docs: DataFrame, fold_id: int, num_folds: int = EVAL_FOLDS,
                  seed: int = EVAL_SEED) -> DataFrame:
    """``(document, split)`` with ``split = 'test'`` for fold ``fold_id``, else ``'train'``."""
    if not 0 <= fold_id < num_folds:
        raise ValueError(f"fold_id must be in [0, {num_folds})")
    f = kfold_split(docs, num_folds, seed)
    return f.select("document", F.when(F.col("fold") == fold_id, "test").otherwise("train").alias("split"))


def nested_split(docs: DataFrame) -> DataFrame:
    """``(document, split)``: outer fold -> test; inner fold of the rest -> val; else train."""
    outer = split_by_fold(docs, OUTER_FOLD, OUTER_FOLDS, OUTER_SEED)
    rest = outer.where(F.col("split") == "train").select("document")
    inner = split_by_fold(rest, INNER_FOLD, INNER_FOLDS, INNER_SEED)
    inner = inner.select("document", F.when(F.col("split") == "test", "val").otherwise("train").alias("split"))
    return outer.where(F.col("split") == "test").unionByName(inner)


def holdout_split(docs: DataFrame, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """``(document, split)``: the first ``ceil(test_size * n)`` documents of the seeded
    order are the test part."""
    p = seeded_positions(docs, seed)
    n_test = F.ceil(F.col("n") * F.lit(float(test_size)))
    return p.select("document", F.when(F.col("position") < n_test, "test").otherwise("train").alias("split"))


def seeded_shuffle(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``(document, position)`` in the seeded shuffle order."""
    return seeded_positions(docs, seed).select("document", "position")


def test_documents(docs: DataFrame, fold_id: int = EVAL_FOLD, num_folds: int = EVAL_FOLDS,
                   seed: int = EVAL_SEED) -> DataFrame:
    return split_by_fold(docs, fold_id, num_folds, seed).where(F.col("split") == "test").select("document")


def chained_offsets(counts: DataFrame) -> DataFrame:
    """Offsets of corpora loaded one after another.

    ``counts``: ``(corpus, n, max_id)`` per corpus (corpus 0 keeps its ids). Corpus ``i > 0``
    is renumbered from ``offset_i = previous max + 1``; the table gives ``offset`` per corpus
    and ``next_offset`` (the id after the last corpus). Tiny (one row per corpus).
    """
    w = Window.orderBy("corpus").rowsBetween(Window.unboundedPreceding, -1)
    base = F.first(F.when(F.col("corpus") == 0, F.col("max_id") + 1), ignorenulls=True).over(
        Window.orderBy("corpus").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    extra_before = F.coalesce(F.sum(F.when(F.col("corpus") > 0, F.col("n"))).over(w), F.lit(0))
    out = counts.withColumn("_base", base).withColumn(
        "offset", F.when(F.col("corpus") == 0, F.lit(0)).otherwise(F.col("_base") + extra_before).cast("long"))
    return out.withColumn(
        "next_offset",
        F.when(F.col("corpus") == 0, F.col("max_id") + 1).otherwise(F.col("offset") + F.col("n")).cast("long"),
    ).select("corpus", "n", "offset", "next_offset")
