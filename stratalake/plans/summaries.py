"""Daily summaries of Gold that can be added up to any range of days.

Distinct counts and percentiles of a range do not follow from those of its days. What is
kept per tenant and day can be merged instead: sketches of references, the distinct
references themselves, and counts of whole cycle days. Each is small next to the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.plans.gold import cycle_day_counts

#: Registers of a sketch as a power of two; its relative standard error is 1.04 / 2 ** (LG_K / 2).
LG_K = 14
ERROR = 1.04 / 2 ** (LG_K / 2)


def daily_references(silver: DataFrame) -> DataFrame:
    """Each reference once per tenant and day, with its events."""
    return silver.filter(F.col("reference_id").isNotNull()).groupBy(
        "tenant_id", F.to_date("event_timestamp").alias("event_date"), "reference_id").agg(F.count(F.lit(1)).alias("events"))


def daily_sketches(silver: DataFrame) -> DataFrame:
    """Events, newest event and a sketch of the references of each tenant and day."""
    return silver.groupBy("tenant_id", F.to_date("event_timestamp").alias("event_date")).agg(
        F.count(F.lit(1)).alias("events"), F.max("event_timestamp").alias("last_event_ts"),
        F.hll_sketch_agg("reference_id", F.lit(LG_K)).alias("references_sketch"))


def in_range(daily: DataFrame, first: Column, last: Column) -> DataFrame:
    return daily.filter(F.col("event_date").between(first, last))


def estimated_references(sketches: DataFrame, *by: str) -> DataFrame:
    """Events and about how many references, from daily sketches alone."""
    return sketches.groupBy(*by).agg(
        F.sum("events").alias("events"), F.max("last_event_ts").alias("last_event_ts"),
        F.hll_sketch_estimate(F.hll_union_agg("references_sketch")).alias("references"))


def exact_references(daily: DataFrame, *by: str) -> DataFrame:
    """The same number from the distinct references of each day."""
    return daily.groupBy(*by).agg(F.count_distinct("reference_id").alias("references"))


def daily_cycle_counts(cycles: DataFrame) -> DataFrame:
    """How many references of each outcome, started on a day, took how many days."""
    return cycle_day_counts(cycles, "tenant_id", F.to_date("started_at").alias("started_on"), "final_status")
