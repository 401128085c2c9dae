"""Anomaly rules over the history of data-quality results, all tenants in one job.

The history is already aggregated to one row per tenant, check and day, so a series
has at most as many rows as the look-back has days. One shuffle by series feeds every
rule; only the comparison between tenants needs a second grouping.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.functions.scalars import alert_channel, alert_text
from stratalake.functions.selection import weighted_median
from stratalake.operators.quality import BETWEEN, IN_SET, NOT_NULL, REGEX, ROW_COUNT
from stratalake.sources.publish import append_once

HISTORY_DAYS = 30
#: Without these an event belongs to nothing: the contracts check them at sev1.
KEY_COLUMNS = ("tenant_id", "event_id", "event_timestamp", "reference_id")
PLATFORM_CHANNEL = "#platform-alerts"
SERIES = ("tenant_id", "layer", "expectation_type", "column_name")

# Fixed thresholds of the rules, in percent.
NULL_RATE_LIMIT = 20.0
VOLUME_LIMIT = 50.0
GOLD_VOLUME_LIMIT = 30.0
DAY_DROP_LIMIT = 50.0
WEEK_CHANGE_LIMIT = 20.0
UNEXPECTED_LIMIT = 10.0
DRIFT_POINTS = 5.0
MAD_FACTOR = 3 * 1.4826

REMEDIATION = {
    "null_rate": NOT_NULL, "null_rate_rising": NOT_NULL,
    "volume_vs_week": ROW_COUNT, "volume_day_drop": ROW_COUNT, "volume_week_change": ROW_COUNT,
    "format_drift": REGEX, "unexpected_share": IN_SET, "unexpected_trend": IN_SET,
    "out_of_range": BETWEEN, "tenant_divergence": BETWEEN,
}


def active_history(history: DataFrame, registry: DataFrame, as_of, days: int = HISTORY_DAYS):
    """Results of active tenants in the look-back window."""
    active = registry.filter(F.col("state") == "ACTIVE").select("tenant_id")
    recent = history.filter(F.col("run_date") >= F.date_sub(F.lit(as_of).cast("date"), days))
    return recent.join(active, "tenant_id", "left_semi")


def metric(history: DataFrame) -> DataFrame:
    """The figure each series is judged by: rows for volume, failing share otherwise."""
    value = F.when(F.col("expectation_type") == ROW_COUNT, F.col("observed_value"))
    return history.select(
        *SERIES, "run_date", value.otherwise(F.col("unexpected_pct")).alias("value"))


def fill_days(series: DataFrame) -> DataFrame:
    """One row per day between the first and last run of each series.

    Each row is stretched up to the day before the next one, so no calendar join is
    needed. A day without a run counts as zero rows, and as unknown for shares.
    """
    w = Window.partitionBy(*SERIES).orderBy("run_date")
    last = F.coalesce(F.date_sub(F.lead("run_date").over(w), 1), F.col("run_date"))
    absent = F.when(F.col("expectation_type") == ROW_COUNT, F.lit(0.0))
    return (
        series.withColumn("_last", last)
        .withColumn("day", F.explode(F.sequence("run_date", "_last")))
        .withColumn("value", F.when(F.col("day") == F.col("run_date"), F.col("value"))
                    .otherwise(absent))
        .select(*SERIES, F.col("day").alias("run_date"), "value")
    )


def change_pct(current: Column, base: Column) -> Column:
    """Relative change in percent; unknown when the base is zero."""
    return (current - base) * F.lit(100.0) / F.nullif(base, F.lit(0.0))


def trend_figures(history: DataFrame) -> DataFrame:
    """Every rolling figure the rules use, from one ordering of each series."""
    series = fill_days(metric(history)).withColumn("_d", F.unix_date("run_date"))
    ordered = Window.partitionBy(*SERIES).orderBy("_d")
    week_before = ordered.rangeBetween(-7, -1)
    two_weeks = ordered.rangeBetween(-13, 0)
    two_weeks_before = ordered.rangeBetween(-14, -1)
    value, before = F.col("value"), F.lag("value").over(ordered)

    rising = F.coalesce(value > before, F.lit(False))
    full = F.count("value").over(two_weeks) == 14
    slope = F.when(full, F.regr_slope(F.col("value"), F.col("_d")).over(two_weeks))
    known = F.count("value").over(two_weeks_before) >= 7
    frame = (
        series.withColumn("baseline", F.avg("value").over(week_before))
        .withColumn("day_before", before)
        .withColumn("week_ago", F.lag("value", 7).over(ordered))
        .withColumn("slope_14", slope)
        .withColumn("lowest", F.when(known, F.min("value").over(two_weeks_before)))
        .withColumn("highest", F.when(known, F.max("value").over(two_weeks_before)))
        .withColumn("_rising", rising)
        .withColumn("_climbing", F.coalesce(F.col("slope_14") > 1e-9, F.lit(False)))
        .withColumn("_r", F.sum(F.when(~F.col("_rising"), 1).otherwise(0)).over(ordered))
        .withColumn("_c", F.sum(F.when(~F.col("_climbing"), 1).otherwise(0)).over(ordered))
    )

    def run(flag: str, part: str) -> Column:
        days = F.sum(F.when(F.col(flag), 1).otherwise(0))
        return days.over(Window.partitionBy(*SERIES, part).orderBy("_d"))

    return (
        frame.withColumn("rising_days", run("_rising", "_r"))
        .withColumn("climbing_days", run("_climbing", "_c"))
        .withColumn("delta_pct", change_pct(value, F.col("baseline")))
        .drop("_d", "_rising", "_climbing", "_r", "_c")
    )


PEERS = ("layer", "expectation_type", "column_name", "run_date")


def peer_figures(history: DataFrame) -> DataFrame:
    """Median and median absolute deviation over all tenants, per check and day.

    Values are counted, and the medians selected from the counts, so no task holds the
    tenants of a check. The few medians are joined back.
    """
    values = metric(history)
    counts = values.groupBy(*PEERS, "value").agg(F.count(F.lit(1)).alias("n"))
    middle = weighted_median(counts, PEERS, "value", "n", "peer_median")
    away = F.abs(F.col("value") - F.col("peer_median")).alias("away")
    distances = _with(counts, middle).select(*PEERS, away, "n")
    spread = weighted_median(distances, PEERS, "away", "n", "peer_mad")
    return _with(_with(values, middle), spread).withColumn("away", F.abs(F.col("value") - F.col("peer_median")))


def _with(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """The figures of each row's check and day; a check of no column has a NULL there."""
    own = figures.select(*[F.col(c).alias(f"_{c}") if c in PEERS else F.col(c) for c in figures.columns])
    on = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PEERS])
    return rows.join(own, on, "left").drop(*[f"_{c}" for c in PEERS])


def _record(rule: str, severity: Column | str, current: Column, base: Column, delta: Column,
            text: str) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    current, base = current.cast("double"), base.cast("double")
    return F.struct(
        F.lit(rule).alias("metric"), level.alias("severity"),
        F.round(current, 4).alias("current_value"), F.round(base, 4).alias("baseline_value"),
        F.round(delta, 4).alias("delta_pct"), F.lit(text).alias("description"),
    )


def _hits(df: DataFrame, rules: Sequence[tuple[Column, Column]]) -> DataFrame:
    """One row per rule that fires."""
    found = F.array(*[F.when(fires, record) for fires, record in rules])
    return df.select(*SERIES, "run_date", F.inline(F.filter(found, lambda r: r.isNotNull())))


def series_anomalies(history: DataFrame, volume_limits: dict[str, float] | None = None):
    """Rules that compare a series with its own past."""
    limits = {"gold": GOLD_VOLUME_LIMIT} if volume_limits is None else volume_limits
    limit = F.lit(VOLUME_LIMIT)
    for layer, pct in limits.items():
        limit = F.when(F.col("layer") == layer, pct).otherwise(limit)

    kind, value, base = F.col("expectation_type"), F.col("value"), F.col("baseline")
    volume, nulls, formats = kind == ROW_COUNT, kind == NOT_NULL, kind == REGEX
    share = ~volume
    delta = F.col("delta_pct")
    day_delta = change_pct(value, F.col("day_before"))
    week_delta = change_pct(value, F.col("week_ago"))
    trend_level = F.when(F.col("climbing_days") > 14, "sev2").otherwise("sev3")
    below, above = value < F.col("lowest"), value > F.col("highest")
    edge = F.when(below, F.col("lowest")).otherwise(F.col("highest"))
    return _hits(trend_figures(history), [
        (nulls & F.col("column_name").isin(*KEY_COLUMNS) & (value > NULL_RATE_LIMIT),
         _record("null_rate", "sev1", value, base, delta, "Null rate of a key column is too high")),
        (volume & (F.abs(delta) > limit),
         _record("volume_vs_week", "sev1", value, base, delta,
                 "Volume is far from its 7-day average")),
        (volume & (day_delta < -DAY_DROP_LIMIT),
         _record("volume_day_drop", "sev1", value, F.col("day_before"), day_delta,
                 "Volume fell within one day")),
        (volume & (F.abs(week_delta) > WEEK_CHANGE_LIMIT),
         _record("volume_week_change", "sev2", value, F.col("week_ago"), week_delta,
                 "Volume changed over 7 days")),
        (nulls & (F.col("rising_days") >= 7),
         _record("null_rate_rising", "sev2", value, base, delta,
                 "Null rate rose on 7 days in a row")),
        (share & (value > UNEXPECTED_LIMIT),
         _record("unexpected_share", "sev2", value, base, delta, "Too many unexpected values")),
        (share & (F.col("climbing_days") > 0),
         _record("unexpected_trend", trend_level, value, base, delta,
                 "Unexpected values increase over 14 days")),
        (formats & (value - base > DRIFT_POINTS),
         _record("format_drift", "sev2", value, base, delta,
                 "More values miss the expected format")),
        (below | above,
         _record("out_of_range", "sev3", value, edge, change_pct(value, edge),
                 "Value outside its own 14-day range")),
    ])


def peer_anomalies(history: DataFrame) -> DataFrame:
    """Tenants far from the platform median of the same check and day."""
    value, middle = F.col("value"), F.col("peer_median")
    far = (F.col("peer_mad") > 1e-9) & (F.col("away") > F.col("peer_mad") * MAD_FACTOR)
    return _hits(peer_figures(history), [(far, _record(
        "tenant_divergence", "sev3", value, middle, change_pct(value, middle),
        "Tenant differs from the platform baseline"))])


def detect(history: DataFrame) -> DataFrame:
    """All anomalies in a history, one row per series, day and rule."""
    return series_anomalies(history).unionByName(peer_anomalies(history))


def route(anomalies: DataFrame) -> DataFrame:
    """Where each anomaly goes, with its message; nothing is sent from here."""
    loud = F.col("severity").isin("sev1", "sev2")
    text = alert_text("severity", "tenant_id", "layer", "metric", "current_value",
                      F.coalesce("baseline_value", F.lit(0.0)),
                      F.coalesce("delta_pct", F.lit(0.0)), "description")
    return (
        anomalies.withColumn("to_alerts", loud)
        .withColumn("to_remediation", F.col("severity") == "sev1")
        .withColumn("channel", F.when(loud, alert_channel("tenant_id")))
        .withColumn("message", F.when(loud, text))
    )


def deliveries(anomalies: DataFrame) -> DataFrame:
    """One row per message and channel: the tenant's own, and the platform's for sev1 too."""
    channels = F.array(F.col("channel"), F.when(F.col("severity") == "sev1", F.lit(PLATFORM_CHANNEL)))
    return route(anomalies).filter("to_alerts").withColumn("channel", F.explode(F.array_compact(channels)))


def proposals(anomalies: DataFrame) -> DataFrame:
    """The expectation to add for each remediation-worthy anomaly."""
    kinds = F.create_map(*[F.lit(x) for pair in REMEDIATION.items() for x in pair])
    return anomalies.filter(F.col("severity") == "sev1").select(
        "tenant_id", "layer", "metric", "column_name", kinds[F.col("metric")]
        .alias("proposed_expectation"),
    ).distinct()


def alert_rows(anomalies: DataFrame, detected_at: Column) -> DataFrame:
    """Rows of the alert table."""
    return anomalies.select(
        "tenant_id", "layer", "metric", "severity", "current_value", "baseline_value",
        "delta_pct", "description", detected_at.alias("detected_at"),
        F.lit(False).alias("resolved"),
    ).select(*S.DQ_ALERTS.fieldNames())


def alerts_of_day(history: DataFrame, registry: DataFrame, as_of, days: int = HISTORY_DAYS) -> DataFrame:
    """Alert rows of one run: what the look-back shows about ``as_of`` itself, of active tenants."""
    day = F.lit(as_of).cast("date")
    seen = active_history(history.filter(F.col("run_date") <= day), registry, as_of, days)
    return alert_rows(detect(seen).filter(F.col("run_date") == day), day.cast("timestamp"))


def write_alerts(history: DataFrame, registry: DataFrame, as_of: str, path: str) -> bool:
    """The daily run: today's alerts go to the alert table once, however often it is started."""
    return append_once(alerts_of_day(history, registry, as_of), path, f"alerts-{as_of}", ())
