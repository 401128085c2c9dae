"""Structured Streaming: landing files into Bronze, and Bronze into Silver."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalake.operators.silver import merge_into, silver_projection
from stratalake.schemas import BRONZE_STORED
from stratalake.session import new_path
from stratalake.sources.bronze import accepted, append_bronze, append_rejects, landed_lines, rejected
from stratalake.sources.publish import as_stored


def bronze_stream(
    spark: SparkSession, landing: str, bronze: str, checkpoint: str, batch_id: Column,
    max_files: int | None = None, rejects: str | None = None,
) -> StreamingQuery:
    """Append newly landed files to Bronze, each file exactly once, then stop.

    Files are read and parsed once: a micro-batch's lines are written with what was read
    from them, and from there events go to Bronze and the other lines to the table
    ``rejects`` (``bronze`` with ``_rejects`` behind it). Both sinks know the loads they
    have, so a micro-batch that is repeated adds nothing.
    """
    beside = rejects or f"{bronze.rstrip('/')}_rejects"

    def route(batch: DataFrame, epoch: int) -> None:
        session, load = batch.sparkSession, f"{os.path.basename(checkpoint.rstrip('/'))}-{epoch:08d}"
        where = new_path(session, "landed_lines")
        batch.write.parquet(where)
        lines = session.read.schema(batch.schema).parquet(where)
        append_rejects(rejected(lines, batch_id), beside, load)
        append_bronze(accepted(lines, batch_id), bronze, load)

    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        landed_lines(reader, landing).writeStream.foreachBatch(route)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def silver_stream(
    spark: SparkSession, bronze: str, silver: str, checkpoint: str, run_ts: Column | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Merge new Bronze rows into Silver, then stop.

    A micro-batch is read once and touches the folders of its events' buckets only. One that
    is repeated, or that comes late, leaves the table that any other order would leave.
    """
    stamp_ts = F.current_timestamp() if run_ts is None else run_ts

    def merge(batch: DataFrame, _epoch: int) -> None:
        merge_into(batch.sparkSession, silver, silver_projection(batch), stamp_ts)

    reader = spark.readStream.schema(as_stored(BRONZE_STORED))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return (
        reader.parquet(bronze).writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
