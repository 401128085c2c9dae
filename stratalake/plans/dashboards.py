"""Queries behind the tenant dashboards, over Gold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake.functions.scalars import on_or_after, pct, ratio, week_start
from stratalake.plans.gold import cycle_day_counts


def total_events(kpi: DataFrame) -> DataFrame:
    return kpi.groupBy("tenant_id").agg(F.sum("event_count").alias("total_events"))


def events_by(kpi: DataFrame, *columns: str) -> DataFrame:
    return kpi.groupBy("tenant_id", *columns).agg(F.sum("event_count").alias("events"))


def events_over_time(kpi: DataFrame, as_of, days: int = 30) -> DataFrame:
    recent = kpi.filter(F.col("event_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return events_by(recent, "event_date", "event_type")


def approval_volume(kpi: DataFrame, value: str = "approved", column: str = "status") -> DataFrame:
    """Daily volume of one value; the data carries approvals in ``status``."""
    return events_by(kpi.filter(F.col(column) == value), "event_date")


def approval_rate(kpi: DataFrame, value: str = "approved", column: str = "status") -> DataFrame:
    hits = F.sum(F.when(F.col(column) == value, F.col("event_count")).otherwise(0))
    return kpi.groupBy("tenant_id").agg(
        pct(hits, F.sum("event_count"), 1).alias("approval_rate_pct"))


def average_cycle(cycles: DataFrame) -> DataFrame:
    return cycles.groupBy("tenant_id").agg(
        ratio(F.sum("cycle_days"), F.count(F.lit(1)), 4).alias("avg_cycle_days"))


def cycle_histogram(cycles: DataFrame, bins: int = 20) -> DataFrame:
    """Equal-width bins between each tenant's shortest and longest cycle."""
    return cycle_histogram_of(cycle_day_counts(cycles, "tenant_id"), bins)


def cycle_histogram_of(days: DataFrame, bins: int = 20) -> DataFrame:
    """The bins from counts of whole days, of one day or of many.

    The range is a window over that small frame instead of a second pass. The longest cycle
    belongs to the last bin.
    """
    tenant = Window.partitionBy("tenant_id")
    lo, hi = F.min("cycle_days").over(tenant), F.max("cycle_days").over(tenant)
    position = F.floor((F.col("cycle_days") - F.col("lo")) * bins / F.nullif(
        F.col("hi") - F.col("lo"), F.lit(0)))
    return (
        days.withColumn("lo", lo).withColumn("hi", hi)
        .withColumn("bin", F.least(F.coalesce(position, F.lit(0)), F.lit(bins - 1)).cast("int") + 1)
        .groupBy("tenant_id", "bin").agg(F.sum("n").alias("refs"))
    )


def cycle_percentiles_by_week(cycles: DataFrame) -> DataFrame:
    return cycle_percentiles_of(cycle_day_counts(cycles, "tenant_id", week_start("started_at").alias("week")))


def cycle_percentiles_of(days: DataFrame) -> DataFrame:
    return days.groupBy("tenant_id", "week").agg(
        F.expr("percentile(cycle_days, array(0.5D, 0.95D), n)").alias("_p")
    ).select("tenant_id", "week", F.round(F.col("_p")[0], 2).alias("p50"),
             F.round(F.col("_p")[1], 2).alias("p95"))


def volume_by_source(detail: DataFrame) -> DataFrame:
    return detail.groupBy("tenant_id", "source_system").agg(F.count(F.lit(1)).alias("events"))


def active_references(detail: DataFrame, as_of, days: int = 30) -> DataFrame:
    recent = detail.filter(on_or_after("event_timestamp", as_of, days))
    return recent.groupBy("tenant_id").agg(
        F.countDistinct("reference_id").alias("active_references"))


def activity_heatmap(detail: DataFrame) -> DataFrame:
    day: Column = F.to_date("event_timestamp").alias("day")
    return detail.groupBy("tenant_id", day).agg(F.count("event_id").alias("events"))


def weekly_volume(funnel: DataFrame) -> DataFrame:
    return funnel.select(
        "tenant_id", F.col("week_start").alias("week"), "approved", "rejected", "pending_audit",
        "escalated", "total", "approval_rate_pct",
    )
