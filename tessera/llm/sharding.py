"""Shards by jump consistent hashing, with gapless slots inside each shard."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tessera.llm.common import bucket_offsets, checkpoint, hash60

#: Multiplier of the 64-bit linear congruential step, a fixed value of the published method.
STEP = np.uint64(2862933555777941757)
SLOT_BUCKETS = 1024


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key: the last jump that lands below ``shards``."""
    state, at = keys.astype(np.uint64), np.zeros(len(keys), np.int64)
    out, live = np.zeros(len(keys), np.int64), np.arange(len(keys))
    while live.size:
        out[live] = at[live]
        state[live] = state[live] * STEP + np.uint64(1)
        stretch = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        at[live] = ((out[live] + 1) * stretch).astype(np.int64)
        live = live[at[live] < shards]
    return out


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0..shards-1 of a long key; raising ``shards`` by one moves rows to the new shard only."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf(IntegerType())
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return of(key)


def stable_key(col: Column) -> Column:
    """Long key of any castable column; null counts as the empty string."""
    return hash60(F.coalesce(col.cast("string"), F.lit("")))


def with_slots(df: DataFrame, shard: str, order: Column, ties: list[str]) -> DataFrame:
    """Add ``slot``, gapless from 0 in each shard, in the order of the 60-bit ``order`` and ``ties``.

    Two levels: the top bits of ``order`` cut a shard into ``SLOT_BUCKETS`` runs whose counts give
    the offsets, and rows are numbered inside a run, so a shard is never sorted by one task.
    Rows equal in ``order`` and ``ties`` are interchangeable.
    """
    df = df.withColumn("_o", order).withColumn("_b", F.shiftright("_o", 50).cast("int"))
    df = checkpoint(df)
    offsets = bucket_offsets(df, [shard], "_b", {"_before": F.count(F.lit(1))})
    run = Window.partitionBy(shard, "_b").orderBy("_o", *ties)
    placed = df.join(offsets, [shard, "_b"]).withColumn("slot", F.col("_before") + F.row_number().over(run) - 1)
    return placed.drop("_o", "_b", "_before")


def assign_shards(df: DataFrame, shards: int, key_col: str = "doc_id") -> DataFrame:
    """``df`` with ``shard`` and ``grown_shard`` (its shard were there one more). No shuffle.

    Only the key and the shard count decide. Rows of equal keys, repeated rows included, share a
    shard; a null key is the key "". An empty table gives an empty result. Columns of the same
    names are replaced.
    """
    key = stable_key(F.col(key_col))
    return df.withColumns({"shard": jump_shard(key, shards), "grown_shard": jump_shard(key, shards + 1)})


def write_shards(df: DataFrame, path: str, shards: int, key_col: str = "doc_id", files: int = 8) -> None:
    """Write Parquet folders ``shard=0..``; ``files`` tasks write each shard, so none holds it whole."""
    part = F.pmod(F.xxhash64(*df.columns), F.lit(files))
    dealt = assign_shards(df, shards, key_col).drop("grown_shard").repartition("shard", part)
    dealt.write.partitionBy("shard").parquet(path)
