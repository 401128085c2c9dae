"""Structured Streaming: the daily KPI by event time, with a rule for late rows."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratalake.operators.silver import silver_projection
from stratalake.schemas import BRONZE_STORED, DAILY_KPI, SET_ASIDE_EVENTS
from stratalake.sources.publish import append_once, as_stored

#: Days stay open this long after their end.
OPEN_FOR = "5 days"


def set_aside_reason(open_for: str = OPEN_FOR) -> Column:
    """Why a Bronze version can't count towards its (UTC) day, or NULL if it can.

    ``untimed``: its event time is missing or unreadable. ``ahead``: it arrived before it is said
    to have happened, so that its time would close days too early. ``late``: its day had closed
    when it arrived. Each row is judged by its own two times, so the answer does not depend
    on how files fall into micro-batches.
    """
    at, arrived = F.col("event_timestamp"), F.col("_ingested_at")
    micros, day = F.unix_micros(at), F.lit(86_400_000_000)
    closes = F.timestamp_micros(micros - F.pmod(micros, day) + day) + F.expr(f"INTERVAL {open_for}")
    return (
        F.when(at.isNull() | arrived.isNull(), "untimed").when(at > arrived, "ahead").when(arrived >= closes, "late")
    )


def closed_days(versions: DataFrame, open_for: str = OPEN_FOR, disorder: str = "0 days") -> DataFrame:
    """Daily KPI of the closed days of a stream of typed Bronze versions that are in time.

    Three windowed aggregations follow one another: versions to events (the first version
    inserts an event, the newest status sets its status; see ``event_state``), events to
    references, references to groups, so distinct references are exact. A day leaves, whole
    and once, when the newest event is ``open_for`` and ``disorder`` past its end; state holds
    open days only.
    Versions of one event must name the same day, or they count in each.
    """
    key = ["tenant_id", "event_id"]
    first = F.struct("_ingested_at", "_batch_id", "status", "event_type", "event_timestamp", "reference_id")
    latest = F.struct("_ingested_at", "_batch_id", "status")
    group = ["tenant_id", "event_type", "status"]
    events = (
        versions.withWatermark("event_timestamp", f"{open_for} {disorder}")
        .groupBy(F.window("event_timestamp", "1 day"), *key)
        .agg(F.min(first).alias("first"), F.max(F.when(F.col("status").isNotNull(), latest)).alias("latest"))
        .select("window", "tenant_id", "first.event_type", "first.event_timestamp", "first.reference_id",
                F.when(F.col("first.status").isNotNull(), F.col("latest.status")).alias("status"))
    )
    references = (
        events.groupBy(F.window("window", "1 day"), *group, "reference_id")
        .agg(F.count(F.lit(1)).alias("events"), F.min("event_timestamp").alias("low"), F.max("event_timestamp").alias("high"))
    )
    return (
        references.groupBy(F.window("window", "1 day"), *group)
        .agg(F.sum("events").alias("event_count"), F.count("reference_id").alias("unique_references"),
             F.min("low").alias("first_event_ts"), F.max("high").alias("last_event_ts"))
        .withColumn("event_date", F.date_from_unix_date((F.unix_seconds("window.start") / 86_400).cast("int")))
        .select(*DAILY_KPI.fieldNames())
    )


def _bronze_rows(spark: SparkSession, bronze: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(as_stored(BRONZE_STORED))
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(bronze)


def _sink(path: str, checkpoint: str):
    """Appends each micro-batch once, also if it is repeated after a lost driver."""
    def write(batch: DataFrame, epoch: int) -> None:
        append_once(batch, path, f"{os.path.basename(checkpoint.rstrip('/'))}-{epoch:08d}")
    return write


def daily_kpi_stream(
    spark: SparkSession, bronze: str, kpi: str, checkpoint: str, open_for: str = OPEN_FOR,
    max_files: int | None = None, disorder: str = "0 days",
) -> StreamingQuery:
    """Append the KPI rows of every day that closes, then stop; the next run goes on from there.

    ``disorder`` is how much later a row of an earlier micro-batch may have arrived than a row
    of a later one: nothing if each run takes the loads since the last one whole, and the
    arrivals that one load spans if ``max_files`` cuts loads. Days wait that much longer. A
    row in time is then never behind the watermark, as the newest event read before it is at
    most ``disorder`` newer than its arrival, and its day had not closed by then. ``finished``
    tells if that did not hold.
    """
    versions = silver_projection(_bronze_rows(spark, bronze, max_files))
    return (
        closed_days(versions.filter(set_aside_reason(open_for).isNull()), open_for, disorder)
        .writeStream.outputMode("append").foreachBatch(_sink(kpi, checkpoint))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def finished(query: StreamingQuery) -> None:
    """Wait for a run; raises if state dropped rows, which the set-aside table would not have."""
    query.awaitTermination()
    dropped = sum(state.numRowsDroppedByWatermark for p in query.recentProgress for state in p.stateOperators)
    if dropped:
        raise RuntimeError(f"{dropped} rows in time came behind the watermark: files are further out of order than `disorder`")


def set_aside_stream(
    spark: SparkSession, bronze: str, late: str, checkpoint: str, open_for: str = OPEN_FOR, max_files: int | None = None,
) -> StreamingQuery:
    """Append the rows that ``daily_kpi_stream`` leaves out, with the reason, then stop."""
    rows = _bronze_rows(spark, bronze, max_files).withColumn("reason", set_aside_reason(open_for)).filter("reason IS NOT NULL")
    return (
        rows.select(*SET_ASIDE_EVENTS.fieldNames()).writeStream.foreachBatch(_sink(late, checkpoint))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
