"""Incremental ingestion of model responses with Structured Streaming.

The reference rewrites its prediction file after every experiment so a
crashed run keeps finished work. Here responses arrive as files (one row per
``model, row_id, exp, raw, received``); each micro-batch is parsed with the same
column expressions as the batch path and written with dynamic partition
overwrite per (model, exp, batch). The stream's offsets live under the session's
shared folder, so a restarted query resumes where it stopped and a replayed
batch rewrites the same partitions (idempotent).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from viewpoint.operators.prompts import response_content, response_text
from viewpoint.schemas import RESPONSES as RESPONSE_SCHEMA
from viewpoint.session import ensure_checkpoint_dir

KEYS = ["model", "row_id", "exp"]


def parse_responses(df: DataFrame) -> DataFrame:
    """Batch and stream: parsed text, error flag, the raw body and when it came."""
    return df.select(
        *KEYS,
        response_text(F.col("raw")).alias("pred"),
        response_content(F.col("raw")).isNull().alias("is_error"),
        F.col("raw").alias("raw_response"),
        "received",
    )


def _last(df: DataFrame, order: list[str]) -> DataFrame:
    """One row per request: the last by ``order``, equal ones by their body."""
    row = F.max_by(F.struct("pred", "is_error", "raw_response", "received"), F.struct(*order, "raw_response")).alias("r")
    return df.groupBy(*KEYS).agg(row).select(*KEYS, "r.*")


def _sink(out_dir: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        # Each micro-batch owns the partitions (model, exp, batch); with dynamic
        # overwrite a replayed batch replaces exactly its own files.
        out = _last(batch, ["received"]).withColumn("batch", F.lit(batch_id))
        writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("model", "exp", "batch").parquet(out_dir)

    return write


def latest(spark: SparkSession, out_dir: str) -> DataFrame:
    """Current predictions: per (model, row_id, exp) the response received last,
    of those received together the one of the later batch."""
    return _last(spark.read.parquet(out_dir), ["received", "batch"])


def start_ingest(
    spark: SparkSession,
    source_dir: str,
    out_dir: str,
    name: str = "responses",
    fmt: str = "parquet",
    available_now: bool = True,
) -> StreamingQuery:
    """Start the ingest stream from ``source_dir`` into ``out_dir``."""
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    stream = spark.readStream.schema(RESPONSE_SCHEMA).format(fmt).load(source_dir)
    writer = parse_responses(stream).writeStream.foreachBatch(_sink(out_dir)).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
