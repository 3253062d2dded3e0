"""A corpus pipeline of five of the numbered operators, from ``documents`` to sharded documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Rows are named by two 64-bit hashes of id and text. Rows repeated with one id and
text share their fate until the near-duplicate stage, which keeps one of them.
Null texts are empty texts: never toxic by content, never copies, never contaminated. An empty
table passes through every stage. Extra columns are kept, also if named like an operator's own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, mixing, near_dup, sharding, toxicity
from tessera.llm.common import bitmap, checkpoint, in_bitmap, row_key, table

SHARDS = 16


def with_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_tessera_key", row_key("doc_id", "text"))


def asked(docs: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` that a fixed-size bitmap of ``keys(_tessera_key)`` clears, and the others with their key.

    The cleared rows stay where they are; only the others, the rows in question and a few more, are to be shuffled.
    """
    hit = in_bitmap(bitmap(keys, "_tessera_key.a"), row_key("doc_id", "text")["a"])
    marked = docs.withColumn("_tessera_ask", hit)
    return (marked.where("not _tessera_ask").drop("_tessera_ask"),
            with_key(marked.where("_tessera_ask").drop("_tessera_ask")))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``keys(key)``."""
    keys = checkpoint(keys.select(F.col("key").alias("_tessera_key")).distinct())
    clear, rest = asked(docs, keys)
    return clear.unionByName(rest.join(keys, "_tessera_key", "left_anti").drop("_tessera_key"))


def once(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each id and text: repeats are counted by key, and only they are shuffled."""
    keys = with_key(docs).groupBy("_tessera_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_tessera_key")
    clear, rest = asked(docs, checkpoint(keys))
    return clear.unionByName(rest.dropDuplicates(["_tessera_key"]).drop("_tessera_key"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5; it learns from four of five labelled ids."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.in_fold(F.col("doc_id"), 5) != 0)
    return docs.where(toxicity.score(model, F.col("text")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates; of a repeated row, one."""
    return once(without(docs, near_dup.near_duplicates(docs).where("not kept")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("n_hit > 0"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole time (0 to 3);
    documents without words once.

    All of a source's documents are taken equally often or once more but one, which the target cuts; so a
    source misses its target by half that document at most.
    """
    taken = mixing.taken_words(docs)
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor(F.col("taken") / F.col("size") + 0.5)).cast("int")
    copies = taken.select(F.col("key").alias("_tessera_key"), times.alias("_tessera_times")).groupBy("_tessera_key").agg(
        F.max("_tessera_times").alias("_tessera_times")).where("_tessera_times > 0")
    rows = with_key(docs).join(copies, "_tessera_key")
    rows = rows.withColumn("_tessera_copy", F.explode(F.array_repeat(F.lit(1), F.col("_tessera_times"))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard (column ``shard``); copies of one document share it."""
    return sharding.assign_shards(docs, SHARDS).drop("grown_shard")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the trained classifier or the connected components over MinHash candidates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
