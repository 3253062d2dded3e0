"""Rule tagging of documents as they arrive.

The detectors are per-document, so a stream needs no state: every micro-batch is a static
DataFrame that goes through the same batch operators (layout, words, e-mail and phone
rules). Output is written per batch id with overwrite, so a retried batch replaces its own
files instead of duplicating them (exactly-once at the sink).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import PRED_COLS, detect_rules
from ..operators.tokens import document_words, layout_by_document
from ..session import checkpoint_dir


def tag_batch(docs: DataFrame) -> DataFrame:
    """Rule hits for a batch of ``(document, text)`` rows, in the prediction schema."""
    laid = layout_by_document(docs)
    return detect_rules(laid, document_words(laid)).select(*PRED_COLS)


def tag_stream(spark: SparkSession, source: str, sink: str, checkpoint: str | None = None,
               available_now: bool = False, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Stream parquet documents (``doc_id, text, ...``) from ``source`` and append rule hits
    under ``sink/batch=<id>``. ``checkpoint`` defaults to a folder under the session's
    shared checkpoint directory."""
    schema = spark.read.parquet(source).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source).select(F.col("doc_id").alias("document"), "text")

    def write(batch: DataFrame, batch_id: int) -> None:
        tag_batch(batch).write.mode("overwrite").parquet(os.path.join(sink, f"batch={batch_id}"))

    ckpt = checkpoint or os.path.join(checkpoint_dir(spark), "tag_stream")
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
