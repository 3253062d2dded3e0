"""Corpora: loading, projecting, renumbering, chaining id offsets, union.

A corpus is ``(document, full_text, tokens, trailing_whitespace, provided_labels)``.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.splits import chained_offsets, positions, range_bucket

RAW_SCHEMA = T.StructType([
    T.StructField("document", T.LongType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("tokens", T.ArrayType(T.StringType())),
    T.StructField("trailing_whitespace", T.ArrayType(T.BooleanType())),
    T.StructField("labels", T.ArrayType(T.StringType())),
])
CORPUS_COLS = ("document", "full_text", "tokens", "trailing_whitespace", "provided_labels")


def load_corpus_json(spark: SparkSession, path: str, json_lines: bool = False, split: bool = True) -> DataFrame:
    """Read raw corpus files with an explicit schema (no inference).

    JSON Lines split across tasks by themselves. A file holding one JSON array is cut into records by
    :func:`array_records`, so many tasks read one file; ``split=False`` reads each file in one task.
    """
    reader = spark.read.schema(RAW_SCHEMA)
    if json_lines:
        return reader.json(path)
    if not split:
        return reader.option("multiLine", True).json(path)
    parsed = F.from_json("record", RAW_SCHEMA, {"mode": "FAILFAST"})
    return array_records(spark, path, RAW_SCHEMA.fieldNames()).select(parsed.alias("r")).select("r.*")


def array_records(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """``(record)``: the text of each object of files that hold one JSON array of flat objects.

    The files are read as text cut at ``{``, which Spark splits by byte ranges. A piece opens a record if it
    begins with one of the record's ``fields`` as a key: a quote inside a JSON string is escaped, so no text can
    look like that. Any other piece follows a brace inside a string and is glued to the record that it belongs to,
    also across the ranges; a range's pieces are numbered by its own task, and only one row per range is
    ordered over the file. Fails on text before the first record that isn't an opening bracket.
    """
    keys = "|".join(re.escape(f) for f in fields)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"))
    pieces = spark.read.option("lineSep", "{").text(path).select(place.alias("p"), F.monotonically_increasing_id().alias("n"), "value")
    pieces = pieces.select("p.file", "p.range", "n", "value", F.col("value").rlike(rf'^\s*"(?:{keys})"\s*:').alias("opens"))
    order = Window.partitionBy("file", "range").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = pieces.withColumn("record_no", F.sum(F.col("opens").cast("long")).over(order))
    ranges = numbered.groupBy("file", "range").agg(F.max("record_no").alias("last"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    owner = F.last(F.when(F.col("last") > 0, F.struct("range", "last")), ignorenulls=True).over(earlier)
    owned = numbered.join(ranges.select("file", "range", owner.alias("owner")), ["file", "range"])
    late = (F.col("record_no") == 0)
    glued = owned.select(
        "file", F.when(late, F.col("owner.range")).otherwise(F.col("range")).alias("of_range"),
        F.when(late, F.col("owner.last")).otherwise(F.col("record_no")).alias("no"), "range", "n", "value")
    whole = glued.groupBy("file", "of_range", "no").agg(F.array_sort(F.collect_list(F.struct("range", "n", "value"))).alias("parts"))
    text = F.concat(F.lit("{"), F.array_join(F.transform("parts", lambda x: x["value"]), "{"))
    head = F.array_join(F.transform("parts", lambda x: x["value"]), "{")
    stray = F.raise_error(F.concat(F.lit("not a JSON array of objects: "), F.substring(head, 1, 60)))
    # Before the first record there is a bracket alone; after each a comma or the closing bracket.
    record = F.when(F.col("no").isNotNull(), F.regexp_replace(text, r"[\s,\]]+$", "")).when(
        head.rlike(r"^\x{FEFF}?\s*(\[\s*(\]\s*)?)?$"), F.lit(None)).otherwise(stray)
    return whole.select(record.alias("record")).where("record is not null")


def corpus_project(raw: DataFrame) -> DataFrame:
    """Raw records -> corpus schema (``labels`` becomes ``provided_labels``)."""
    return raw.select("document", "full_text", "tokens", "trailing_whitespace",
                      F.col("labels").alias("provided_labels"))


def renumber(corpus: DataFrame, offset: int | None, order_col: str = "document") -> DataFrame:
    """Replace ids by ``offset + position`` (position by the old id; input order does not
    survive a distributed read). ``offset`` 0 / None keeps the ids."""
    if offset is None or offset <= 0:
        return corpus
    key = F.col(order_col)
    ranked = positions(corpus.withColumn("_old", key), key, range_bucket(corpus, key), tiebreak="_old")
    return ranked.withColumn("document", (F.lit(int(offset)) + F.col("position")).cast("long")).drop(
        "_old", "position", "n")


def renumber_chained(docs: DataFrame) -> DataFrame:
    """Renumber several corpora loaded one after another (``corpus`` column, 0 = base).

    The base keeps its ids; corpus ``i`` starts at the id after corpus ``i - 1``. Offsets
    come from a per-corpus count table joined on ``corpus``; positions inside a corpus are
    bucketed ranks by old id, so no corpus is ranked in one task.
    Adds ``source_document`` (the old id).
    """
    stats = docs.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.max("document").alias("max_id"))
    offs = chained_offsets(stats).select("corpus", "offset")
    key = F.col("document")
    ranked = positions(docs.withColumn("source_document", key), key, range_bucket(docs, key),
                       tiebreak="source_document", group_cols=("corpus",))
    j = ranked.join(offs, "corpus", "inner")
    return j.withColumn(
        "document",
        F.when(F.col("corpus") == 0, F.col("source_document")).otherwise(F.col("offset") + F.col("position")).cast("long"),
    ).drop("position", "n", "offset")


def next_offset(corpus: DataFrame) -> DataFrame:
    """One row ``(offset)`` = max id + 1."""
    return corpus.agg((F.max("document") + 1).cast("long").alias("offset"))


def head_fraction(corpus: DataFrame, fraction_denominator: int = 10, order_col: str = "document",
                  group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Keep the leading ``n // d`` documents (by id order) of each group, as a slice of a
    list would."""
    key = F.col(order_col)
    ranked = positions(corpus.withColumn("_old", key), key, range_bucket(corpus, key), tiebreak="_old",
                       group_cols=group_cols)
    return ranked.where(F.col("position") < F.floor(F.col("n") / fraction_denominator)).drop(
        "_old", "position", "n")


def corpus_union(corpora: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name, schemas aligned by an explicit cast of the first."""
    first = corpora[0]
    out = first
    for c in corpora[1:]:
        out = out.unionByName(c.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in first.schema.fields]))
    return out
