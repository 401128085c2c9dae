"""Inventory of schemas, tables and columns as ordinary frames."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.functions.scalars import schema_purpose

COLUMNS = "schema_name string, table_name string, ordinal int, column_name string, " \
          "data_type string, is_nullable string"


def column_inventory(spark: SparkSession, tables: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """One row per column, from metadata only."""
    rows = [
        (schema, table, i + 1, f.name, f.dataType.simpleString().upper(),
         "YES" if f.nullable else "NO")
        for (schema, table), df in tables.items() for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, COLUMNS)


def table_inventory(tables: Mapping[tuple[str, str], DataFrame]) -> DataFrame:
    """One row per table with its purpose, number of columns and number of rows."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(schema).alias("schema_name"), F.lit(table).alias("table_name"),
            schema_purpose(F.lit(schema)).alias("purpose"),
            F.lit(len(df.columns)).alias("column_count"), "row_count",
        )
        for (schema, table), df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def session_tables(spark: SparkSession, pattern: str = "%") -> DataFrame:
    """Tables and views known to the session's catalog, filtered with LIKE."""
    rows = [
        (db.name, t.name, t.tableType)
        for db in spark.catalog.listDatabases() for t in spark.catalog.listTables(db.name)
    ]
    found = spark.createDataFrame(rows, "schema_name string, table_name string, table_type string")
    return found.filter(F.col("table_name").like(pattern)).orderBy("schema_name", "table_name")
