"""Gold models and reports, for all tenants in one job.

Distinct counts are planned by Spark as partial aggregates on (group, value) first,
so no tenant has to fit into one task. Windows only run over aggregated frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.functions.scalars import cycle_hours, on_or_after, outcome, pct, ratio, week_start

LOOKBACK_DAYS = 90


def _flag(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0))


def daily_kpi(
    silver: DataFrame, as_of, days: int = LOOKBACK_DAYS, share_of_day: bool = True
) -> DataFrame:
    """Events and distinct references by tenant, date, type and status."""
    base = (
        silver.filter(on_or_after("event_timestamp", as_of, days))
        .groupBy("tenant_id", F.to_date("event_timestamp").alias("event_date"),
                 "event_type", "status")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.countDistinct("reference_id").alias("unique_references"),
            F.min("event_timestamp").alias("first_event_ts"),
            F.max("event_timestamp").alias("last_event_ts"),
        )
    )
    if not share_of_day:
        return base
    day = F.sum("event_count").over(Window.partitionBy("tenant_id", "event_date"))
    return base.withColumn("pct_of_day", pct(F.col("event_count"), day, 2))


def event_detail(silver: DataFrame, tenant_id: str | None = None) -> DataFrame:
    rows = silver if tenant_id is None else silver.filter(F.col("tenant_id") == tenant_id)
    return rows.select(
        "tenant_id", "event_id", "event_type", "event_timestamp", "source_system", "status",
        "reference_id", "created_at", "last_updated_at",
    )


def cycle_time_terminal(silver: DataFrame) -> DataFrame:
    """Short form: span between terminal events; rows without a reference form a group."""
    start, end = F.min("event_timestamp"), F.max("event_timestamp")
    return (
        silver.filter(F.col("status").isin(S.TERMINAL_STATUSES))
        .groupBy("tenant_id", "reference_id")
        .agg(
            start.alias("started_at"), end.alias("completed_at"),
            F.datediff(end, start).alias("cycle_days"),
            F.countDistinct("event_type").alias("step_count"),
        )
    )


def lifecycle(silver: DataFrame) -> DataFrame:
    status = F.col("status")
    finished = F.when(status.isin(S.TERMINAL_STATUSES), F.col("event_timestamp"))
    return (
        silver.filter(F.col("reference_id").isNotNull())
        .groupBy("tenant_id", "reference_id")
        .agg(
            F.min("event_timestamp").alias("started_at"),
            F.max(finished).alias("completed_at"),
            F.countDistinct("event_type").alias("step_count"),
            F.count(F.lit(1)).alias("total_events"),
            _flag(status == "approved").alias("was_approved"),
            _flag(status == "rejected").alias("was_rejected"),
            _flag(status.isin(S.ESCALATED_STATUSES)).alias("was_escalated"),
        )
    )


def cycle_time(silver: DataFrame) -> DataFrame:
    """Canonical form: first event of any kind to last terminal event; open ones left out."""
    days = F.datediff("completed_at", "started_at")
    return (
        lifecycle(silver)
        .filter(F.col("completed_at").isNotNull())
        .withColumn("cycle_days", days)
        .withColumn("cycle_hours", cycle_hours(F.col("cycle_days")))
        .withColumn("final_status", outcome(
            F.col("was_approved"), F.col("was_rejected"), F.col("was_escalated")))
    )


FUNNEL_STEPS = {
    "submitted": "pending", "in_review": "in_progress", "pending_audit": "pending_audit",
    "escalated": "escalated", "approved": "approved", "rejected": "rejected",
}


def approval_funnel(silver: DataFrame, as_of, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Distinct references per week and status, one column per step.

    ``total`` counts a reference once per status it had in the week.
    """
    weekly = (
        silver.filter(on_or_after("event_timestamp", as_of, days))
        .groupBy("tenant_id", week_start("event_timestamp").alias("week_start"), "status")
        .agg(F.countDistinct("reference_id").alias("refs"))
    )
    steps = [
        F.sum(F.when(F.col("status") == status, F.col("refs")).otherwise(0)).alias(name)
        for name, status in FUNNEL_STEPS.items()
    ]
    return (
        weekly.groupBy("tenant_id", "week_start")
        .agg(*steps, F.sum("refs").alias("total"))
        .withColumn("approval_rate_pct", pct(F.col("approved"), F.col("total"), 1))
        .withColumn("rejection_rate_pct", pct(F.col("rejected"), F.col("total"), 1))
    )


def volume_by_type(bronze: DataFrame) -> DataFrame:
    return bronze.groupBy("tenant_id", "event_type").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("event_timestamp").alias("earliest"),
        F.max("event_timestamp").alias("latest"),
    )


def vendor_tier(typed: DataFrame) -> DataFrame:
    """Activity and amounts by vendor and approval tier.

    Amounts are added as decimals: a sum of doubles depends on the order of the rows,
    which decides how an average half-way between two cents is rounded. Both distinct counts
    come from one chain of groupings (rows to events, events to workflows, those to groups),
    where Spark would send every row three times for two of them side by side.
    """
    group = ["tenant_id", "vendor_code", "approval_tier"]
    amount = F.expr("try_cast(amount_usd AS decimal(20, 6))")
    # An event of several workflows counts with the first of them; one of none keeps a NULL.
    events = typed.groupBy(*group, "event_id").agg(
        F.sum(amount).alias("amount"), F.count(amount).alias("n"), F.collect_set("workflow_id").alias("workflows"))
    each = events.select(*group, "event_id", "amount", "n", F.posexplode_outer("workflows").alias("at", "workflow_id"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    workflows = each.groupBy(*group, "workflow_id").agg(
        F.count_if(first & F.col("event_id").isNotNull()).alias("events"),
        F.sum(F.when(first, F.col("amount"))).alias("amount"), F.sum(F.when(first, F.col("n"))).alias("n"))
    total, n = F.sum("amount"), F.sum("n")
    return workflows.groupBy(*group).agg(
        F.sum("events").alias("events"),
        F.count("workflow_id").alias("workflows"),
        F.round(total / F.nullif(n, F.lit(0)), 2).cast("double").alias("avg_amount_usd"),
        F.round(total, 2).cast("double").alias("total_amount_usd"),
    )


def top_per_tenant(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of each tenant; cut to k per tenant inside map tasks already."""
    rank = F.row_number().over(Window.partitionBy("tenant_id").orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k)


def cycle_day_counts(cycles: DataFrame, *by: Column | str) -> DataFrame:
    """References per whole number of days; counts of parts add up to those of the whole."""
    return cycles.groupBy(*by, "cycle_days").agg(F.count(F.lit(1)).alias("n"))


def outcome_statistics(cycles: DataFrame) -> DataFrame:
    """Cycle-day statistics by outcome with exact interpolated percentiles."""
    return outcome_statistics_of(cycle_day_counts(cycles, "tenant_id", "final_status"))


def outcome_statistics_of(days: DataFrame) -> DataFrame:
    """The statistics from counts of whole days, of one day or of many: the percentile sees
    one entry per distinct number of days however many references there are.
    """
    levels = "array(0.25D, 0.5D, 0.75D, 0.95D)"
    stats = days.groupBy("tenant_id", "final_status").agg(
        F.sum("n").alias("refs"),
        F.sum(F.col("cycle_days") * F.col("n")).alias("_days"),
        F.expr(f"percentile(cycle_days, {levels}, n)").alias("_p"),
        F.min("cycle_days").alias("min_days"),
        F.max("cycle_days").alias("max_days"),
    )
    quantiles = [
        F.round(F.col("_p")[i], 1).alias(name)
        for i, name in enumerate(["p25_days", "p50_days", "p75_days", "p95_days"])
    ]
    return stats.select(
        "tenant_id", "final_status", "refs", ratio(F.col("_days"), F.col("refs"), 1)
        .alias("avg_cycle_days"), *quantiles, "min_days", "max_days",
    )


def status_distribution(silver: DataFrame) -> DataFrame:
    total = F.sum("events").over(Window.partitionBy("tenant_id"))
    return (
        silver.groupBy("tenant_id", "status")
        .agg(F.count(F.lit(1)).alias("events"),
             F.countDistinct("reference_id").alias("unique_references"))
        .withColumn("pct", pct(F.col("events"), total, 1))
    )


def reconciliation(bronze: DataFrame, silver: DataFrame) -> DataFrame:
    """Rows and distinct ids of both layers, side by side."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("tenant_id").agg(
            F.count(F.lit(1)).alias("row_count"),
            F.countDistinct("event_id").alias("unique_events"),
        ).withColumn("layer", F.lit(name))

    return side(bronze, "bronze (raw)").unionByName(side(silver, "silver (dedup)"))


def kpi_cards(kpi: DataFrame) -> DataFrame:
    """Headline figures; the reference total adds daily distinct counts and over-counts."""
    approved = F.sum(F.when(F.col("status") == "approved", F.col("event_count")).otherwise(0))
    return kpi.groupBy("tenant_id").agg(
        F.sum("event_count").alias("total_events"),
        F.sum("unique_references").alias("total_unique_references"),
        pct(approved, F.sum("event_count"), 1).alias("approval_rate_pct"),
    )


def distinct_references(silver: DataFrame, as_of, days: int) -> DataFrame:
    """True number of references in a look-back window."""
    return (
        silver.filter(on_or_after("event_timestamp", as_of, days))
        .groupBy("tenant_id").agg(F.countDistinct("reference_id").alias("unique_references"))
    )


def cycle_cards(cycles: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return cycles.groupBy("tenant_id").agg(
        ratio(F.sum("cycle_days"), n, 2).alias("avg_cycle_days"),
        pct(F.sum("was_escalated"), n, 1).alias("escalation_rate_pct"),
    )


def freshness(silver: DataFrame) -> DataFrame:
    return silver.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.max("_ingested_at").alias("newest_arrival"),
        F.countDistinct("reference_id").alias("unique_references"),
    )
