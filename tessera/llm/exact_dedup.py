"""Exact duplicates: a Misra-Gries split of heavy digests from the rest (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import ascii_lower, checkpoint

#: Counters of each Misra-Gries summary, and digests that may count as heavy: bounds of the broadcast.
COUNTERS = 4096
HEAVY = 1024


def fold_ascii(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def digests(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """One slim row per input row: its id and the SHA-256 (hex) of the normalised text."""
    return df.select(F.col(id_col).alias("id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"))


def heavy_hitters(d: DataFrame, counters: int = COUNTERS, heavy: int = HEAVY) -> DataFrame:
    """At most ``heavy`` digests: every digest with over rows/``heavy`` rows, and perhaps others.

    Spark's frequent-items sketch is the mergeable Misra-Gries summary. Tasks fold into 64
    sketches of ``counters`` counters, and those into one, so the last step reads 64 rows.
    """
    parts = d.groupBy(F.pmod(F.spark_partition_id(), F.lit(64)).alias("p")).agg(
        F.expr(f"approx_top_k_accumulate(digest, {counters})").alias("s"))
    # Grouped, although by one value: a partition without sketches must not add an empty one.
    top = parts.groupBy((F.col("p") < 0).alias("one")).agg(F.expr(f"approx_top_k_combine(s, {counters})").alias("s")).where("s is not null")
    items = top.select(F.explode(F.expr(f"approx_top_k_estimate(s, {heavy})")).alias("t"))
    return items.where("t.count > 1").select(F.col("t.item").alias("digest"))


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row of ``df``, dropped rows too.

    Rows are equal when ``text`` (default: column ``text`` with A-Z lower-cased, null as empty) is;
    the largest id stays. The heavy digests are counted exactly first; their winners, at most
    ``HEAVY`` rows, are broadcast, so copies of a text that fills a third of the input never leave
    their map task. All other digests are grouped and joined by an ordinary shuffle.

    Null ids lose to any id; a group with null ids alone keeps them all (``keep_id`` null, ids
    equal). Repeated rows of one id and text are one document: all are marked alike. An empty
    table gives an empty result. Only the two input columns are read, so others may have any name.
    """
    norm = fold_ascii(F.col("text")) if text is None else text
    d = checkpoint(digests(df, id_col, norm))
    heavy = F.broadcast(heavy_hitters(d))
    winner = [F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    won = checkpoint(d.join(heavy, "digest", "left_semi").groupBy("digest").agg(*winner))
    often = d.join(F.broadcast(won), "digest")
    rest = d.join(F.broadcast(won.select("digest")), "digest", "left_anti")
    seldom = rest.join(rest.groupBy("digest").agg(*winner), "digest")
    cols = ["id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest"]
    return often.select(*cols).unionByName(seldom.select(*cols))


def drop_duplicates(df: DataFrame, id_col: str = "doc_id", text: Column | None = None) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    stay = duplicate_groups(df, id_col, text).where("kept").select(F.col("id").alias("_keep")).distinct()
    return df.join(stay, F.col(id_col).eqNullSafe(F.col("_keep")), "left_semi")
