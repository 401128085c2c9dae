"""Gold models, reports, sorting, set operations and dashboard queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalake.functions.scalars import json_text, on_or_after, pct, schema_purpose, week_start
from stratalake.operators.silver import silver_projection
from stratalake.plans import dashboards as D
from stratalake.plans import gold as G
from stratalake.plans import summaries as Y
from stratalake.registry.base import query, sql_pct
from stratalake.schemas import TERMINAL_STATUSES
from stratalake.sources.tables import AS_OF, Tables

TYPED = ("workflow_id", "approval_tier", "vendor_code", "amount_usd")


def typed_first(t: Tables):
    return silver_projection(t.bronze_first(), ("reference_id",), TYPED)


def kpi(t: Tables):
    return G.daily_kpi(t.silver, AS_OF, share_of_day=False)


# --- Scalar expressions and predicates ------------------------------------------------
@query("p01_payload_fields", """
SELECT event_id, payload ->> '$.status' AS status, payload ->> '$.reference_id' AS reference_id,
  payload ->> '$.vendor_code' AS vendor_code, payload ->> '$.no_such_field' AS no_such_field
FROM v_bronze""")
def _(t):
    return t.bronze().select(
        "event_id", *[json_text("payload", f).alias(f)
                      for f in ("status", "reference_id", "vendor_code", "no_such_field")])


@query("p02_safe_casts", """
SELECT event_id, try_cast(payload ->> '$.amount_usd' AS DOUBLE) AS amount_usd,
  try_cast(payload ->> '$.vendor_code' AS DOUBLE) AS not_a_number,
  try_cast(source_system AS TIMESTAMP) AS not_a_time,
  try_cast(CAST(event_timestamp AS VARCHAR) AS TIMESTAMP) AS event_time
FROM v_bronze_first""")
def _(t):
    return typed_first(t).select(
        "event_id",
        F.expr("try_cast(amount_usd AS double)").alias("amount_usd"),
        F.expr("try_cast(vendor_code AS double)").alias("not_a_number"),
        F.expr("try_cast(source_system AS timestamp)").alias("not_a_time"),
        F.expr("try_cast(CAST(event_timestamp AS string) AS timestamp)").alias("event_time"))


@query("p03_audit_stamp", f"""
SELECT tenant_id, event_id, TIMESTAMP '{AS_OF}' AS refreshed_at, 'silver.events' AS record_source
FROM v_silver""")
def _(t):
    return t.silver.select(
        "tenant_id", "event_id", F.lit(AS_OF).cast("timestamp").alias("refreshed_at"),
        F.lit("silver.events").alias("record_source"))


@query("p04_newest_parsed_events", """
SELECT event_id, event_type, event_timestamp, source_system, approval_tier, vendor_code,
  CAST(amount_usd AS DOUBLE) AS amount_usd, status
FROM v_silver WHERE tenant_id = 'tenant-1'
ORDER BY event_timestamp DESC, event_id LIMIT 25""")
def _(t):
    return (
        typed_first(t).filter(F.col("tenant_id") == "tenant-1")
        .select("event_id", "event_type", "event_timestamp", "source_system", "approval_tier",
                "vendor_code", F.expr("try_cast(amount_usd AS double)").alias("amount_usd"),
                "status")
        .orderBy(F.desc("event_timestamp"), "event_id").limit(25))


@query("p05_tenant_filter", """
SELECT event_id, event_type, event_timestamp, status FROM v_silver WHERE tenant_id = 'tenant-3'""")
def _(t):
    return t.silver.filter(F.col("tenant_id") == "tenant-3").select(
        "event_id", "event_type", "event_timestamp", "status")


@query("p06_p07_terminal_with_reference", """
SELECT tenant_id, event_id, status, reference_id FROM v_silver
WHERE status IN ('completed', 'approved', 'rejected') AND reference_id IS NOT NULL""")
def _(t):
    return t.silver.filter(
        F.col("status").isin(TERMINAL_STATUSES) & F.col("reference_id").isNotNull()
    ).select("tenant_id", "event_id", "status", "reference_id")


@query("p08_lookback_window", f"""
SELECT tenant_id, count(*) AS n, min(event_timestamp) AS earliest FROM v_silver
WHERE event_timestamp >= DATE '{AS_OF}' - 7 GROUP BY ALL""")
def _(t):
    return t.silver.filter(on_or_after("event_timestamp", AS_OF, 7)).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("event_timestamp").alias("earliest"))


@query("p09_status_differs", """
SELECT f.tenant_id, f.event_id, f.payload ->> '$.status' AS before, x.payload ->> '$.status' AS after
FROM v_bronze_first f JOIN v_bronze_fixes x USING (tenant_id, event_id)
WHERE (f.payload ->> '$.status') <> (x.payload ->> '$.status')""")
def _(t):
    first = t.bronze_first().select(
        "tenant_id", "event_id", json_text("payload", "status").alias("before"))
    fixes = t.bronze_fixes().select(
        "tenant_id", "event_id", json_text("payload", "status").alias("after"))
    return first.join(fixes, ["tenant_id", "event_id"]).filter(F.col("before") != F.col("after"))


@query("p10_schema_name_pattern", """
WITH named AS (SELECT CASE n % 4 WHEN 0 THEN 'gold_' || user_id WHEN 1 THEN 'goldX' || user_id
  WHEN 2 THEN 'monitoring' ELSE 'silver' END AS schema_name FROM v_ev)
SELECT CASE WHEN schema_name LIKE 'gold_%' THEN 'per-tenant Gold'
  WHEN schema_name = 'monitoring' THEN 'platform monitoring' ELSE schema_name END AS purpose,
  count(*) AS n FROM named GROUP BY ALL""")
def _(t):
    name = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("gold_"), F.col("user_id")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("goldX"), F.col("user_id")))
        .when(F.col("event_id") % 4 == 2, F.lit("monitoring")).otherwise("silver"))
    return t.raw("events").groupBy(schema_purpose(name).alias("purpose")).agg(
        F.count(F.lit(1)).alias("n"))


@query("p11_p12_day_and_week", """
SELECT event_id, CAST(event_timestamp AS DATE) AS event_date,
  CAST(date_trunc('week', event_timestamp) AS DATE) AS week_start FROM v_silver""")
def _(t):
    return t.silver.select("event_id", F.to_date("event_timestamp").alias("event_date"),
                           week_start("event_timestamp").alias("week_start"))


@query("p13_day_difference", """
SELECT event_id, CAST(date_diff('day', CAST(event_timestamp AS DATE), CAST(_ingested_at AS DATE))
  AS INT) AS days, round(date_diff('day', CAST(event_timestamp AS DATE),
  CAST(_ingested_at AS DATE)) * 24.0, 1)::DOUBLE AS hours FROM v_bronze_first""")
def _(t):
    days = F.datediff("_ingested_at", "event_timestamp")
    return t.bronze_first().select(
        "event_id", days.alias("days"), F.round(days * F.lit(24.0), 1).alias("hours"))


@query("p16_outcome_precedence", """
SELECT tenant_id, reference_id, final_status FROM v_cycle""")
def _(t):
    return G.cycle_time(t.silver).select("tenant_id", "reference_id", "final_status")


@query("p17_default_and_divide_guard", """
SELECT tenant_id, event_type, coalesce(status, 'unknown') AS status,
  CAST(count(reference_id) AS BIGINT) AS with_reference,
  count(*) / NULLIF(CAST(count(reference_id) AS DOUBLE), 0) AS rows_per_reference
FROM v_typed GROUP BY ALL""".replace("v_typed", "(SELECT tenant_id, event_type, "
      "payload ->> '$.status' AS status, payload ->> '$.reference_id' AS reference_id "
      "FROM v_bronze)"))
def _(t):
    typed = silver_projection(t.bronze(), ("reference_id",))
    return typed.groupBy(
        "tenant_id", "event_type", F.coalesce("status", F.lit("unknown")).alias("status")
    ).agg(
        F.count("reference_id").alias("with_reference"),
        (F.count(F.lit(1)).cast("double") / F.nullif(F.count("reference_id"), F.lit(0)))
        .alias("rows_per_reference"))


@query("p18_rounded_shares", f"""
SELECT tenant_id, status, {sql_pct('count(*)', 'sum(count(*)) OVER (PARTITION BY tenant_id)', 2)}
  AS share_2, {sql_pct('count(*)', 'sum(count(*)) OVER (PARTITION BY tenant_id)', 1)} AS share_1
FROM v_silver GROUP BY tenant_id, status""")
def _(t):
    total = F.sum("n").over(Window.partitionBy("tenant_id"))
    return (
        t.silver.groupBy("tenant_id", "status").agg(F.count(F.lit(1)).alias("n"))
        .select("tenant_id", "status", pct(F.col("n"), total, 2).alias("share_2"),
                pct(F.col("n"), total, 1).alias("share_1")))


# --- Aggregations -----------------------------------------------------------------------
@query("a01_daily_kpi", "SELECT * FROM v_kpi")
def _(t):
    return kpi(t)


_SHARE = sql_pct("event_count", "sum(event_count) OVER (PARTITION BY tenant_id, event_date)", 2)


@query("a02_w01_daily_kpi_with_share", f"SELECT *, {_SHARE} AS pct_of_day FROM v_kpi")
def daily_kpi_with_share(t):
    return G.daily_kpi(t.silver, AS_OF)


@query("a03_cycle_time_terminal_events", """
SELECT tenant_id, reference_id, min(event_timestamp) AS started_at,
  max(event_timestamp) AS completed_at,
  CAST(date_diff('day', CAST(min(event_timestamp) AS DATE), CAST(max(event_timestamp) AS DATE))
    AS INT) AS cycle_days, count(DISTINCT event_type) AS step_count
FROM v_silver WHERE status IN ('completed', 'approved', 'rejected') GROUP BY ALL""")
def _(t):
    return G.cycle_time_terminal(t.silver)


@query("a04_cycle_time_lifecycle", "SELECT * FROM v_cycle")
def _(t):
    return G.cycle_time(t.silver)


@query("a05_weekly_approval_funnel", f"""
SELECT *, {sql_pct('approved', 'total', 1)} AS approval_rate_pct,
  {sql_pct('rejected', 'total', 1)} AS rejection_rate_pct FROM v_funnel""")
def _(t):
    return G.approval_funnel(t.silver, AS_OF)


@query("a06_volume_by_event_type", """
SELECT tenant_id, event_type, count(*) AS event_count, min(event_timestamp) AS earliest,
  max(event_timestamp) AS latest FROM v_bronze GROUP BY ALL""")
def _(t):
    return G.volume_by_type(t.bronze())


_CENTS = "sum(CAST(round(CAST(amount_usd AS DOUBLE) * 100) AS BIGINT))"
_VENDOR = f"""
SELECT tenant_id, vendor_code, approval_tier, count(DISTINCT event_id) AS events,
  count(DISTINCT workflow_id) AS workflows,
  {sql_pct(_CENTS, 'count(*) * 100', 2, scale=1)} AS avg_amount_usd,
  CAST({_CENTS} AS DOUBLE) / 100 AS total_amount_usd
FROM v_silver GROUP BY ALL"""


@query("a07_vendor_tier_top20", f"""
SELECT *, CAST(row_number() OVER (PARTITION BY tenant_id
  ORDER BY total_amount_usd DESC, vendor_code, approval_tier) AS INT) AS rank
FROM ({_VENDOR}) QUALIFY rank <= 20""")
def _(t):
    order = [F.desc("total_amount_usd"), F.col("vendor_code"), F.col("approval_tier")]
    return G.top_per_tenant(G.vendor_tier(typed_first(t)), order, 20)


@query("o03_top_vendors_overall", f"""
SELECT * FROM ({_VENDOR}) ORDER BY total_amount_usd DESC, tenant_id, vendor_code, approval_tier
LIMIT 20""")
def _(t):
    return G.vendor_tier(typed_first(t)).orderBy(
        F.desc("total_amount_usd"), "tenant_id", "vendor_code", "approval_tier").limit(20)


@query("a08_outcome_statistics", f"""
SELECT tenant_id, final_status, count(*) AS refs,
  {sql_pct('sum(cycle_days)', 'count(*)', 1, scale=1)} AS avg_cycle_days,
  round(quantile_cont(cycle_days, 0.25), 1) AS p25_days,
  round(quantile_cont(cycle_days, 0.5), 1) AS p50_days,
  round(quantile_cont(cycle_days, 0.75), 1) AS p75_days,
  round(quantile_cont(cycle_days, 0.95), 1) AS p95_days,
  min(cycle_days) AS min_days, max(cycle_days) AS max_days
FROM v_cycle GROUP BY ALL""")
def _(t):
    return G.outcome_statistics(G.cycle_time(t.silver))


_ALL = "sum(count(*)) OVER (PARTITION BY tenant_id)"


@query("a09_w02_status_distribution", f"""
SELECT tenant_id, status, count(*) AS events, count(DISTINCT reference_id) AS unique_references,
  {sql_pct('count(*)', _ALL, 1)} AS pct FROM v_silver GROUP BY tenant_id, status""")
def _(t):
    return G.status_distribution(t.silver)


@query("a10_u01_bronze_silver_reconciliation", """
SELECT 'bronze (raw)' AS layer, tenant_id, count(*) AS row_count,
  count(DISTINCT event_id) AS unique_events FROM v_bronze GROUP BY ALL
UNION ALL
SELECT 'silver (dedup)', tenant_id, count(*), count(DISTINCT event_id)
FROM v_silver GROUP BY ALL""")
def _(t):
    return G.reconciliation(t.bronze(), t.silver)


@query("a11_kpi_cards", f"""
SELECT tenant_id, CAST(sum(event_count) AS BIGINT) AS total_events,
  CAST(sum(unique_references) AS BIGINT) AS total_unique_references,
  {sql_pct("coalesce(sum(event_count) FILTER (status = 'approved'), 0)", "sum(event_count)", 1)}
    AS approval_rate_pct
FROM v_kpi GROUP BY ALL""")
def _(t):
    return G.kpi_cards(kpi(t))


@query("a11_true_unique_references", f"""
SELECT tenant_id, count(DISTINCT reference_id) AS unique_references FROM v_silver
WHERE event_timestamp >= DATE '{AS_OF}' - 90 GROUP BY ALL""")
def _(t):
    return G.distinct_references(t.silver, AS_OF, 90)


@query("a12_cycle_and_escalation_cards", f"""
SELECT tenant_id, {sql_pct('sum(cycle_days)', 'count(*)', 2, scale=1)} AS avg_cycle_days,
  {sql_pct('sum(was_escalated)', 'count(*)', 1)} AS escalation_rate_pct
FROM v_cycle GROUP BY ALL""")
def _(t):
    return G.cycle_cards(G.cycle_time(t.silver))


@query("a13_rows_per_tenant", "SELECT tenant_id, count(*) AS cnt FROM v_silver GROUP BY ALL")
def _(t):
    return t.silver.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("cnt"))


@query("a14_freshness_figures", """
SELECT tenant_id, count(*) AS row_count, max(_ingested_at) AS newest_arrival,
  count(DISTINCT reference_id) AS unique_references FROM v_silver GROUP BY ALL""")
def _(t):
    return G.freshness(t.silver)


# --- Sorting, top-k, set operations -----------------------------------------------------
@query("o01_newest_bronze_sample", """
SELECT tenant_id, event_id, event_type, event_timestamp, source_system, _batch_id
FROM v_bronze ORDER BY event_timestamp DESC, event_id, _batch_id LIMIT 20""")
def _(t):
    return t.bronze().select(
        "tenant_id", "event_id", "event_type", "event_timestamp", "source_system", "_batch_id"
    ).orderBy(F.desc("event_timestamp"), "event_id", "_batch_id").limit(20)


@query("o01_last_eight_weeks", f"""
SELECT tenant_id, week_start, total, {sql_pct('approved', 'total', 1)} AS approval_rate_pct
FROM v_funnel ORDER BY week_start DESC, tenant_id LIMIT 8""")
def _(t):
    return G.approval_funnel(t.silver, AS_OF).select(
        "tenant_id", "week_start", "total", "approval_rate_pct"
    ).orderBy(F.desc("week_start"), "tenant_id").limit(8)


@query("o02_kpi_latest_thirty", f"""
SELECT tenant_id, event_date, event_type, status, event_count, unique_references, pct_of_day
FROM (SELECT *, {_SHARE} AS pct_of_day FROM v_kpi)
ORDER BY event_date DESC, event_count DESC, tenant_id, event_type, status LIMIT 30""")
def _(t):
    return G.daily_kpi(t.silver, AS_OF).select(
        "tenant_id", "event_date", "event_type", "status", "event_count", "unique_references",
        "pct_of_day",
    ).orderBy(F.desc("event_date"), F.desc("event_count"), "tenant_id", "event_type",
              "status").limit(30)


@query("u02_distinct_keys", "SELECT DISTINCT tenant_id, event_id FROM v_bronze")
def _(t):
    return t.bronze().select("tenant_id", "event_id").distinct()


# --- Dashboards -------------------------------------------------------------------------
@query("d01_total_events", """
SELECT tenant_id, CAST(sum(event_count) AS BIGINT) AS total_events FROM v_kpi GROUP BY ALL""")
def _(t):
    return D.total_events(kpi(t))


@query("d02_events_by_status", """
SELECT tenant_id, status, CAST(sum(event_count) AS BIGINT) AS events FROM v_kpi GROUP BY ALL""")
def _(t):
    return D.events_by(kpi(t), "status")


@query("d03_events_over_time", f"""
SELECT tenant_id, event_date, event_type, CAST(sum(event_count) AS BIGINT) AS events FROM v_kpi
WHERE event_date >= DATE '{AS_OF}' - 30 GROUP BY ALL""")
def _(t):
    return D.events_over_time(kpi(t), AS_OF)


@query("d04_daily_approval_volume", """
SELECT tenant_id, event_date, CAST(sum(event_count) AS BIGINT) AS events FROM v_kpi
WHERE status = 'approved' GROUP BY ALL""")
def _(t):
    return D.approval_volume(kpi(t))


@query("d05_approval_rate", f"""
SELECT tenant_id, {sql_pct("coalesce(sum(event_count) FILTER (status = 'approved'), 0)",
                           "sum(event_count)", 1)} AS approval_rate_pct
FROM v_kpi GROUP BY ALL""")
def _(t):
    return D.approval_rate(kpi(t))


@query("d06_average_cycle_days", f"""
SELECT tenant_id, {sql_pct('sum(cycle_days)', 'count(*)', 4, scale=1)} AS avg_cycle_days
FROM v_cycle GROUP BY ALL""")
def _(t):
    return D.average_cycle(G.cycle_time(t.silver))


@query("d07_cycle_histogram", """
WITH ranged AS (SELECT tenant_id, cycle_days, min(cycle_days) OVER (PARTITION BY tenant_id) AS lo,
  max(cycle_days) OVER (PARTITION BY tenant_id) AS hi FROM v_cycle)
SELECT tenant_id, CAST(least(CASE WHEN hi > lo THEN (cycle_days - lo) * 20 // (hi - lo) ELSE 0 END,
  19) AS INT) + 1 AS bin, count(*) AS refs FROM ranged GROUP BY ALL""")
def _(t):
    return D.cycle_histogram(G.cycle_time(t.silver))


@query("d08_cycle_percentiles_by_week", """
SELECT tenant_id, CAST(date_trunc('week', started_at) AS DATE) AS week,
  round(quantile_cont(cycle_days, 0.5), 2) AS p50, round(quantile_cont(cycle_days, 0.95), 2) AS p95
FROM v_cycle GROUP BY ALL""")
def _(t):
    return D.cycle_percentiles_by_week(G.cycle_time(t.silver))


@query("d09_volume_by_source", """
SELECT tenant_id, source_system, count(*) AS events FROM v_silver GROUP BY ALL""")
def _(t):
    return D.volume_by_source(t.silver)


@query("d10_active_references", f"""
SELECT tenant_id, count(DISTINCT reference_id) AS active_references FROM v_silver
WHERE event_timestamp >= DATE '{AS_OF}' - 30 GROUP BY ALL""")
def _(t):
    return D.active_references(t.silver, AS_OF)


@query("d11_activity_heatmap", """
SELECT tenant_id, CAST(event_timestamp AS DATE) AS day, count(event_id) AS events
FROM v_silver GROUP BY ALL""")
def _(t):
    return D.activity_heatmap(t.silver)


@query("d12_weekly_volume", f"""
SELECT tenant_id, week_start AS week, approved, rejected, pending_audit, escalated, total,
  {sql_pct('approved', 'total', 1)} AS approval_rate_pct FROM v_funnel""")
def _(t):
    return D.weekly_volume(G.approval_funnel(t.silver, AS_OF))


# --- Daily summaries, added up to ranges of days -----------------------------------------
_RANGES = {"last_7": 7, "last_30": 30, "last_90": 90}


def _range_sql(columns: str, days: int, name: str) -> str:
    return f"""SELECT '{name}' AS days, tenant_id, {columns} FROM v_silver
  WHERE CAST(event_timestamp AS DATE) BETWEEN DATE '{AS_OF}' - {days} AND DATE '{AS_OF}' GROUP BY tenant_id"""


def _ranges(t, daily, figures):
    """``figures`` of the daily rows of each look-back range."""
    out, last = None, F.lit(AS_OF).cast("date")
    for name, days in _RANGES.items():
        rows = figures(Y.in_range(daily, F.date_sub(last, days), last)).withColumn("days", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("a11_references_of_ranges_from_days", "\nUNION ALL\n".join(
    _range_sql("count(DISTINCT reference_id) AS unique_references", d, n) for n, d in _RANGES.items()))
def _(t):
    daily = t.stored("daily_references", lambda: Y.daily_references(t.silver), ())
    ranges = _ranges(t, daily, lambda rows: Y.exact_references(rows, "tenant_id"))
    return ranges.select("days", "tenant_id", F.col("references").alias("unique_references"))


@query("a13_a14_figures_of_ranges_from_sketches", "\nUNION ALL\n".join(
    _range_sql("count(*) AS events, max(event_timestamp) AS last_event_ts, true AS references_within_bound", d, n)
    for n, d in _RANGES.items()))
def _(t):
    """Figures of ranges from daily sketches; the estimates are held against the exact numbers."""
    sketches = t.stored("daily_sketches", lambda: Y.daily_sketches(t.silver), ())
    daily = t.stored("daily_references", lambda: Y.daily_references(t.silver), ())
    exact = _ranges(t, daily, lambda rows: Y.exact_references(rows, "tenant_id")).withColumnRenamed("references", "exact")
    about = _ranges(t, sketches, lambda rows: Y.estimated_references(rows, "tenant_id"))
    near = F.abs(F.col("references") - F.col("exact")) <= 1 + 4 * Y.ERROR * F.col("exact")
    return about.join(exact, ["days", "tenant_id"]).select(
        "days", "tenant_id", "events", "last_event_ts", near.alias("references_within_bound"))


def _cycle_counts(t):
    return t.stored("daily_cycle_counts", lambda: Y.daily_cycle_counts(G.cycle_time(t.silver)), ())


@query("a08_statistics_from_daily_counts", same_as="a08_outcome_statistics")
def _(t):
    return G.outcome_statistics_of(_cycle_counts(t).groupBy("tenant_id", "final_status", "cycle_days").agg(F.sum("n").alias("n")))


@query("d07_histogram_from_daily_counts", same_as="d07_cycle_histogram")
def _(t):
    return D.cycle_histogram_of(_cycle_counts(t).groupBy("tenant_id", "cycle_days").agg(F.sum("n").alias("n")))


@query("d08_percentiles_from_daily_counts", same_as="d08_cycle_percentiles_by_week")
def _(t):
    week = F.to_date(F.date_trunc("week", "started_on")).alias("week")
    return D.cycle_percentiles_of(_cycle_counts(t).groupBy("tenant_id", week, "cycle_days").agg(F.sum("n").alias("n")))
