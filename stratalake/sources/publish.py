"""Writing tables: append, full refresh and replacement of touched partitions.

Writes are rebalanced on the partition columns first. Adaptive execution then splits
the partition of a heavy tenant over several tasks and merges small ones, which keeps
the number of files in hand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from stratalake.schemas import LOADS

BY_TENANT = ("tenant_id",)


def _writer(df: DataFrame, partition_by: Sequence[str]):
    if not partition_by:
        return df.write
    return df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = BY_TENANT) -> None:
    _writer(df, partition_by).mode("append").parquet(path)


def full_refresh(df: DataFrame, path: str, partition_by: Sequence[str] = BY_TENANT) -> None:
    """Replace the whole table; partitions that are no longer produced disappear."""
    _writer(df, partition_by).mode("overwrite").option(
        "partitionOverwriteMode", "static").parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str] = BY_TENANT, dealt: bool = False) -> None:
    """Replace only the partitions present in ``df``, which may read the same table.

    Files are staged and moved in at commit, after every task has read its input. Rows that
    are ``dealt`` by partition already are written from where they lie.
    """
    writer = df.write.partitionBy(*partition_by) if dealt else _writer(df, partition_by)
    writer.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").parquet(path)


def append_once(df: DataFrame, path: str, load_id: str, partition_by: Sequence[str] = BY_TENANT) -> bool:
    """Append a load unless the table's ledger has it; whether it was written.

    The rows go to folders of the load, so one that broke off before its ledger row replaces
    what it left. The ledger is a small table beside the data, a row per load.
    """
    spark, ledger = df.sparkSession, f"{path.rstrip('/')}_loads"
    known = read_table(spark, ledger, LOADS)
    if not known.filter(F.col("load_id") == load_id).isEmpty():
        return False
    replace_partitions(df.withColumn("load_id", F.lit(load_id)), path, (*partition_by, "load_id"))
    spark.range(1).select(F.lit(load_id).alias("load_id"), F.current_timestamp().alias("loaded_at")) \
        .write.mode("append").parquet(ledger)
    return True


def as_stored(schema: T.StructType) -> T.StructType:
    """The schema with every field nullable. Folders written by a stream are read by the declared
    schema as it is, and a NULL in a field declared without would come out as zero or 1970."""
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table with its declared types, or no rows when nothing was written yet."""
    try:
        return spark.read.schema(as_stored(schema)).parquet(path).select(*schema.fieldNames())
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def publish_view(df: DataFrame, name: str) -> DataFrame:
    """An always-current view: nothing is stored, every read runs the plan again."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)
