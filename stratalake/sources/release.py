"""Releases of several tables at once: written beside the old ones, audited, then pointed to.

A release has a folder of its own. Readers follow the newest row of a small table of
releases, which is appended only when no sev1 check failed on the files as written, so they
see all tables of one release or all of the one before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.operators.quality import Rule, evaluate
from stratalake.schemas import RELEASES
from stratalake.sources.publish import append, full_refresh, read_table


def _releases(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/_releases", RELEASES)


def release(
    root: str, name: str, tables: Mapping[str, tuple[DataFrame, Sequence[str], Sequence[Rule]]], at: Column
) -> tuple[bool, DataFrame]:
    """Write, audit and publish ``tables`` (frame, partition columns, checks) as release ``name``.

    Every table gets ``refreshed_at``. Returns whether the release is out, and all check
    results per tenant; those of a failed one are the reason. A name that is written again
    replaces its own files; one that is out already stays as it is. At least one table
    has checks.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    results = []
    out = not _releases(spark, root).filter(F.col("release") == name).isEmpty()
    for table, (df, by, rules) in tables.items():
        path, stamped = f"{root}/{name}/{table}", df.withColumn("refreshed_at", at)
        if not out:
            full_refresh(stamped, path, by)
        if rules:
            results.append(evaluate(read_table(spark, path, stamped.schema), rules, table))
    checks = reduce(DataFrame.unionByName, results)
    if not out and checks.filter((F.col("severity") == "sev1") & ~F.col("success")).isEmpty():
        number = _releases(spark, root).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0] + 1
        append(spark.range(1).select(F.lit(name).alias("release"), F.lit(number).cast("long").alias("number"), at.alias("released_at")),
               f"{root}/_releases", ())
        out = True
    return out, checks


def released(spark: SparkSession, root: str, table: str, schema: T.StructType) -> DataFrame:
    """A table of the newest release, or no rows before the first."""
    newest = _releases(spark, root).agg(F.max_by("release", "number")).first()[0]
    return read_table(spark, f"{root}/{newest}/{table}", schema) if newest else spark.createDataFrame([], schema)
