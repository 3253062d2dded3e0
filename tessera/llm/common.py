"""Helpers shared by the operators: tables, shared-folder checkpoints, text folding, ranks."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and cut its lineage.

    A session on a single machine without that setting (tests) gets a private folder; any
    other session without it is an error, because executors could not read the files back.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="tessera-checkpoint-")
        sc.setCheckpointDir(shared)
    kept = df.checkpoint()
    # The files of the shuffles that made it are of no more use: they are dropped now, not when the
    # driver happens to collect its garbage. They belong to this frame's execution alone.
    df._jdf.queryExecution().toRdd().cleanShuffleDependencies(False)
    return kept


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. Pure ASCII texts take the fast built-in, others ``translate``."""
    ascii_only = F.char_length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def row_key(id_col: str, text_col: str) -> Column:
    """Name of a row: two 64-bit hashes ``a`` and ``b`` of its id and text. Repeated rows share it."""
    return F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("a"), F.xxhash64(F.col(text_col), F.col(id_col)).alias("b"))


def hash60(key: Column, part: int = 0) -> Column:
    """60 bits of the MD5 of a string as a non-negative long; ``part`` 0 or 1 picks the half."""
    return F.conv(F.substring(F.md5(key), 1 + 16 * part, 15), 16, 10).cast("long")


def bucket_offsets(df: DataFrame, group: list[str], bucket: str, sums: dict[str, Column]) -> DataFrame:
    """Per (group, bucket): what each sum comes to over all smaller buckets of the group.

    The first level of a two-level rank or running sum. ``bucket`` has a fixed number of values,
    so the window below sees that many rows for each group, however many rows ``df`` has.
    """
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    per = df.groupBy(*group, bucket).agg(*[e.alias(n) for n, e in sums.items()])
    return per.select(*group, bucket, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums])


#: Bits of a membership bitmap: 2 MB, whatever it holds.
BITMAP_BITS = 24


def bitmap(df: DataFrame, hashed: str) -> np.ndarray:
    """Bitmap of the top bits of a long hash column: a filter of fixed size that never misses.

    Built by a grouped ``bit_or``; at most 2**18 words reach the driver. The more values it holds,
    the more others it lets through, so it only ever spares work before an exact join.
    """
    at = F.shiftrightunsigned(hashed, 64 - BITMAP_BITS)
    words = df.select(F.shiftright(at, 6).alias("w"), (at % 64).cast("int").alias("bit")).groupBy("w").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for w, bits in words.collect():
        out[w] = bits
    return out.view(np.uint64)


def bitmap_hits(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which unsigned 64-bit hashes may be in the bitmap."""
    at = hashes >> np.uint64(64 - BITMAP_BITS)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def in_bitmap(words: np.ndarray, hashed: Column) -> Column:
    @F.pandas_udf(BooleanType())
    def hit(values: pd.Series) -> pd.Series:
        return pd.Series(bitmap_hits(words, values.to_numpy(np.int64).view(np.uint64)), dtype=bool)

    return hit(hashed)
