"""Bronze ingestion: raw JSON landing files and batch appends, payload kept as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from stratalake.schemas import BRONZE_EVENTS, BRONZE_PARTITIONS, LANDING_EVENTS, LANDING_REJECTS
from stratalake.sources.publish import append_once

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


_LINES = T.StructType([T.StructField("value", T.StringType()), LANDING_EVENTS["tenant_id"]])
_CORRUPT = "_corrupt_record"
_EVENT = T.StructType([*(f for f in LANDING_EVENTS if f.name != "tenant_id"), T.StructField(_CORRUPT, T.StringType())])


def _stamped(landed: DataFrame, batch_id: Column, *columns: Column | str) -> DataFrame:
    """Add file of origin and batch id."""
    return landed.select(
        *columns,
        "_ingested_at",
        F.col("_file").alias("_source_file"),
        batch_id.cast("string").alias("_batch_id"),
    )


def landed_lines(reader: DataFrameReader | DataStreamReader, landing: str) -> DataFrame:
    """Every landed line with the events read from it; a line may be an array of events.

    Types are declared, never inferred, so no extra pass over the files is made. Lines are
    read as text, so that the text of what is no event is still known.
    """
    lines = reader.schema(_LINES).text(landing).filter(F.trim("value") != "")
    how = {"timestampFormat": TIME_FORMAT, "columnNameOfCorruptRecord": _CORRUPT}
    one = F.array(F.from_json("value", _EVENT, how))
    many = F.from_json("value", T.ArrayType(_EVENT), how)
    return lines.select(
        "tenant_id", "value", F.col("_metadata.file_path").alias("_file"), F.current_timestamp().alias("_ingested_at"),
        F.when(F.ltrim("value").startswith("["), F.coalesce(many, F.array())).otherwise(one).alias("_events"))


def accepted(lines: DataFrame, batch_id: Column) -> DataFrame:
    """Bronze rows: whatever has an event id, with NULL for a value that cannot be read."""
    events = lines.select("tenant_id", "_file", "_ingested_at", F.inline("_events")).filter(F.col("event_id").isNotNull())
    return _stamped(events, batch_id, *LANDING_EVENTS.fieldNames())


def rejected(lines: DataFrame, batch_id: Column) -> DataFrame:
    """Raw text of lines without an event id, and of those that could not be read in full."""
    read = F.forall("_events", lambda e: e["event_id"].isNotNull() & e[_CORRUPT].isNull())
    whole = F.coalesce(read & (F.size("_events") > 0), F.lit(False))
    return _stamped(lines.filter(~whole), batch_id, "tenant_id", F.col("value").alias("raw"))


def read_landing(spark: SparkSession, landing: str, batch_id: str) -> DataFrame:
    """All landed events of all tenants; the tenant comes from the folder name."""
    return accepted(landed_lines(spark.read, landing), F.lit(batch_id))


def read_rejects(spark: SparkSession, landing: str, batch_id: str) -> DataFrame:
    """The landed lines that ``read_landing`` leaves out or cannot read in full, as text."""
    return rejected(landed_lines(spark.read, landing), F.lit(batch_id))


def write_landing(events: DataFrame, landing: str) -> None:
    """Drop event rows into the landing folder as a source system would."""
    events.select(*LANDING_EVENTS.fieldNames()).write.mode("append").partitionBy(
        "tenant_id").option("timestampFormat", TIME_FORMAT).json(landing)


def by_arrival(rows: DataFrame) -> DataFrame:
    """Bronze rows with the week of arrival (its Monday) that their folder is named by."""
    return rows.select(*BRONZE_EVENTS.fieldNames(), F.to_date(F.date_trunc("week", "_ingested_at")).alias("ingest_week"))


def append_bronze(rows: DataFrame, path: str, load_id: str) -> bool:
    """Append a load once (see ``append_once``)."""
    return append_once(by_arrival(rows), path, load_id, BRONZE_PARTITIONS)


def append_rejects(rows: DataFrame, path: str, load_id: str) -> bool:
    return append_once(rows.select(*LANDING_REJECTS.fieldNames()), path, load_id)
