"""Filter interaction audit: what each filter of a chain removes, under every order of the filters."""

from __future__ import annotations

from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import UPPER

LETTERS = "ABCDE"
#: Every order of the filters, and its steps: the fields of a packed counter follow this order.
ORDERS = tuple("".join(p) for p in permutations(LETTERS))
STEPS = tuple((order, step) for order in ORDERS for step in range(1, len(LETTERS) + 1))
#: What a row may add 1 to at a step. Each step has one field for each.
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Bits of a field: counts of rows are longs, so no field can run into the next.
FIELD = 64
GAPS = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """Mask of the filters A to D that a whole text fails (bits 0 to 3); null counts as empty.

    A: under 200 words; B: 100 * distinct words < 50 * words; C: 100 * ``[A-Z]`` > 2 * code points;
    D: holds any of ``#$%&*|``. Words are maximal runs without ASCII white space, case-sensitive.
    """
    t = F.coalesce(text, F.lit(""))
    parts = F.split(t, GAPS)
    # White space at an end of the text, or an empty text, leaves empty parts there alone.
    blanks = F.size(parts) - F.size(F.array_remove(parts, ""))
    words = F.size(parts) - blanks
    distinct = F.size(F.array_distinct(parts)) - (blanks > 0).cast("int")
    upper = F.char_length(t) - F.char_length(F.translate(t, UPPER, ""))
    fails = [words < 200, 100 * distinct.cast("long") < 50 * words.cast("long"),
             100 * upper.cast("long") > 2 * F.char_length(t).cast("long"), t.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).cast("int")


@lru_cache(maxsize=4 << len(LETTERS))
def packed(mask: int, good: bool, toxic: bool) -> int:
    """A row's outcomes at all steps of all orders as one integer: a field of ``FIELD`` bits for each
    step and measure, 1 where the row counts."""
    out = 0
    for at, (order, step) in enumerate(STEPS):
        bit = [1 << LETTERS.index(c) for c in order]
        before = any(mask & b for b in bit[:step - 1])
        fails = bool(mask & bit[step - 1])
        gone = fails and not before
        seen = (not before and not fails, gone, fails and before, mask == bit[step - 1], gone and good, gone and toxic)
        for k, one in enumerate(seen):
            out |= int(one) << FIELD * (len(MEASURES) * at + k)
    return out


def unpacked(total: int) -> list[tuple[int, ...]]:
    """The fields of a sum of packed counters: for each step, its measures in order."""
    raw = total.to_bytes(FIELD // 8 * len(MEASURES) * len(STEPS), "little")
    fields = [int.from_bytes(raw[i:i + FIELD // 8], "little") for i in range(0, len(raw), FIELD // 8)]
    return [tuple(fields[i:i + len(MEASURES)]) for i in range(0, len(fields), len(MEASURES))]


def _report(group: pd.DataFrame) -> pd.DataFrame:
    """The 600 steps of one part, from its rows per class (128 at most)."""
    total = sum(int(r.n) * packed(int(r.mask), bool(r.good), bool(r.toxic)) for r in group.itertuples())
    out = pd.DataFrame(unpacked(total), columns=MEASURES)
    out.insert(0, "step", [step for _, step in STEPS])
    out.insert(0, "filter_order", [order for order, _ in STEPS])
    out.insert(0, "part", group["part"].iloc[0])
    letter = [order[step - 1] for order, step in STEPS]
    out["shapley"] = out["removed"].groupby(letter).transform("sum")
    return out


def classes(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): rows of each part by the filters that they fail and their labels.

    Filter E fails where a smaller id has the same text. Rows are counted by (id, text, part)
    first, so repeated rows meet on the map side; the smallest id of a text and its number of rows
    come from a partial minimum per (text, part), so no task gathers the copies of a text; a text
    then has one row for each part that holds it. Only slim rows are shuffled: a digest of the
    text, never the text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = df.select(
        F.col(id_col).cast("long").alias("id"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), failures(F.col(text_col)).alias("mask"))
    slim = slim.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    flags = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows without an id have no label; their digest deals them over the tasks of the join.
    named = slim.withColumn("key", F.coalesce("id", F.xxhash64("digest"))).withColumn("named", F.col("id").isNotNull())
    flags = flags.withColumnRenamed("id", "key").withColumn("named", F.lit(True))
    rows = named.join(flags, ["key", "named"], "left").select(
        "id", "digest", "part", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"))
    kinds = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("at_low"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    first = F.min("low").over(Window.partitionBy("digest"))
    passed = F.col("nameless") + F.when(F.col("low") == first, F.col("at_low")).otherwise(0)
    split = kinds.withColumn("passed", F.coalesce(passed, F.col("nameless"))).select("part", "good", "toxic", F.inline(F.array(
        F.struct("mask", F.col("passed").alias("n")),
        F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("passed")).alias("n"))))).where("n > 0")
    return split.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: (part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley).

    Every set of failed filters is an integer whose fields hold its outcome at all 600 steps; the
    integers of a part's rows are summed and unpacked. A field has 64 bits, and counts are below
    2**63, so fields never overflow into each other. ``shapley`` sums ``removed`` of the step's
    filter over all orders. ``labels`` is (doc_id, quality, toxic); a document is good or toxic if
    any of its label rows says 1, and neither without a label or an id.

    Null texts are empty texts; a null part is the part of the empty string. Rows with a null id
    never fail E and no row fails E by them. Rows repeated with one id are rows of their own, and
    neither is a copy of the other (the id is not smaller). An empty table gives an empty result.
    Only the three columns are read, so others may have any name.
    """
    schema = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in (*MEASURES, "shapley"))
    return classes(df, labels, id_col, text_col, part_col).groupBy("part").applyInPandas(_report, schema)
