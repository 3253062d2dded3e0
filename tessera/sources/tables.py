"""Reading the input tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tokens import layout_by_document


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def table_bytes(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Bytes of a table's files, asked of the store that holds them (no job)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(path).getLength()


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (),
                sort_by: tuple[str, ...] = ("document", "token"), mode: str = "errorifexists") -> None:
    """Result sink: parquet, one folder per value of ``partition_by`` (a threshold, say), rows
    sorted by ``sort_by`` within each file. Sorting is local to a task: no global order, no
    extra shuffle. ``mode`` as in ``DataFrameWriter``."""
    df.sortWithinPartitions(*partition_by, *sort_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_bucketed(df: DataFrame, table: str, partition_by: tuple[str, ...] = ("threshold",), buckets: int = 32,
                   bucket_by: str = "document", sort_by: tuple[str, ...] = ("document", "token")) -> None:
    """Result sink as a table of the catalog: bucketed by document, sorted inside a bucket, partitioned by, say,
    threshold.

    A run replaces the partitions that it holds and no others, so a threshold can be run again alone. Joins of such
    tables by document read co-located buckets: no exchange. Rows are dealt by bucket before writing, so each
    bucket of a partition is one file. The first run makes the table; later ones must have its columns.
    """
    spark = df.sparkSession
    dealt = df.repartition(buckets, bucket_by)
    if not spark.catalog.tableExists(table):
        (dealt.write.partitionBy(*partition_by).bucketBy(buckets, bucket_by).sortBy(*sort_by)
         .option("partitionOverwriteMode", "dynamic").format("parquet").saveAsTable(table))
        return
    columns = spark.table(table).columns
    dealt.select(*columns).write.option("partitionOverwriteMode", "dynamic").insertInto(table, overwrite=True)


def documents(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = (),
              laid_out: bool = True) -> DataFrame:
    """``documents`` as ``(document, text, *extra)``, hash-partitioned on document."""
    # The explicit not-null filter makes every branch that reads documents share one plan
    # (and so one shuffle) instead of differing by inferred filters.
    df = read_table(spark, sf_dir, "documents").where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("document"), "text", *extra)
    return layout_by_document(df) if laid_out else df
