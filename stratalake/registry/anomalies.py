"""Result history, rolling windows and anomaly rules."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.operators import anomaly as A
from stratalake.operators import quality as Q
from stratalake.operators import silver as SV
from stratalake.registry.base import query
from stratalake.registry.quality import GOOD_VENDOR
from stratalake.registry.views import VIEWS, sql_in
from stratalake.session import new_path
from stratalake.sources.publish import read_table
from stratalake.sources.tables import AS_OF, Tables


def history(t: Tables) -> DataFrame:
    """Silver contract checks per arrival day of fifty tenants."""
    rows = SV.silver_projection(t.bronze("fine"), ("reference_id",), extra=("vendor_code",)).withColumn(
        "run_date", F.to_date("_ingested_at"))
    # An owner that more and more events lack, until it starts again.
    missing = F.substring("event_id", 2, 20).cast("long") % 8 < F.dayofmonth("run_date") % 9
    rows = rows.withColumn("owner", F.when(~missing, "x"))
    rules = [Q.not_null("status", "sev1"), Q.not_null("reference_id", "sev1"), Q.not_null("owner", "sev2"), Q.in_set("status", S.CONTRACT_STATUSES, "sev2"),
             Q.matches("vendor_code", GOOD_VENDOR, "sev2"), Q.row_count(1, None, "sev2")]
    return Q.to_dq_results(Q.evaluate(rows, rules, "silver", group=("tenant_id", "run_date")))


def fine_registry(t: Tables) -> DataFrame:
    """Fifty tenants, active when their users' events carry enough value."""
    return t.raw("events").groupBy(
        F.concat(F.lit("unit-"), F.col("user_id") % 50).alias("tenant_id")
    ).agg(F.when(F.max("value") > 250, "ACTIVE").otherwise("PENDING").alias("state"))


def _share(expectation: str, column: str, bad: str) -> str:
    broken = f"CAST(sum(CASE WHEN {bad} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""SELECT tenant_id, CAST(_ingested_at AS DATE) AS run_date, 'silver' AS layer,
  '{expectation}' AS expectation_type, '{column}' AS column_name, {broken} = 0 AS success,
  CAST({broken} AS DOUBLE) AS observed_value, CAST(0 AS DOUBLE) AS expected_value,
  {broken} AS unexpected_count, {broken} * 100::DOUBLE / count(*) AS unexpected_pct
FROM v_fine_typed GROUP BY ALL"""


VIEWS["v_history"] = "\nUNION ALL\n".join([
    _share(Q.NOT_NULL, "status", "status IS NULL"),
    _share(Q.NOT_NULL, "reference_id", "reference_id IS NULL"),
    _share(Q.NOT_NULL, "owner", "CAST(substr(event_id, 2) AS BIGINT) % 8 < day(_ingested_at) % 9"),
    _share(Q.IN_SET, "status", f"status NOT IN {sql_in(S.CONTRACT_STATUSES)}"),
    _share(Q.REGEX, "vendor_code", f"NOT regexp_matches(vendor_code, '{GOOD_VENDOR}')"),
    f"""SELECT tenant_id, CAST(_ingested_at AS DATE), 'silver', '{Q.ROW_COUNT}', NULL,
  count(*) >= 1, CAST(count(*) AS DOUBLE), CAST(1 AS DOUBLE), NULL, NULL
FROM v_fine_typed GROUP BY ALL""",
])
VIEWS["v_series"] = f"""
SELECT tenant_id, layer, expectation_type, column_name, run_date,
  CASE WHEN expectation_type = '{Q.ROW_COUNT}' THEN observed_value ELSE unexpected_pct END AS value
FROM v_history"""
VIEWS["v_filled"] = f"""
SELECT c.tenant_id, c.layer, c.expectation_type, c.column_name, c.run_date,
  CASE WHEN s.run_date IS NOT NULL THEN s.value WHEN c.expectation_type = '{Q.ROW_COUNT}' THEN 0
  END AS value
FROM (SELECT tenant_id, layer, expectation_type, column_name,
    CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS run_date
  FROM (SELECT tenant_id, layer, expectation_type, column_name, min(run_date) AS lo,
    max(run_date) AS hi FROM v_series GROUP BY ALL)) c
LEFT JOIN v_series s ON c.tenant_id = s.tenant_id AND c.layer = s.layer
  AND c.expectation_type = s.expectation_type
  AND c.column_name IS NOT DISTINCT FROM s.column_name AND c.run_date = s.run_date"""
VIEWS["v_flags"] = """
SELECT *, avg(value) OVER (s RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)
    AS baseline,
  lag(value) OVER s AS day_before, lag(value, 7) OVER s AS week_ago,
  CASE WHEN count(value) OVER (s RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW) = 14 THEN
    regr_slope(value, epoch(run_date) / 86400)
      OVER (s RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW) END AS slope_14,
  CASE WHEN count(value) OVER (s RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)
    >= 7 THEN min(value) OVER (s RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND
    INTERVAL 1 DAY PRECEDING) END AS lowest,
  CASE WHEN count(value) OVER (s RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)
    >= 7 THEN max(value) OVER (s RANGE BETWEEN INTERVAL 14 DAY PRECEDING AND
    INTERVAL 1 DAY PRECEDING) END AS highest
FROM v_filled WINDOW s AS (PARTITION BY tenant_id, layer, expectation_type, column_name
  ORDER BY run_date)"""
_S = "PARTITION BY tenant_id, layer, expectation_type, column_name"
VIEWS["v_trend"] = f"""
SELECT * EXCLUDE (r, c),
  CAST(sum(CASE WHEN coalesce(value > day_before, false) THEN 1 ELSE 0 END)
    OVER ({_S}, r ORDER BY run_date) AS BIGINT) AS rising_days,
  CAST(sum(CASE WHEN coalesce(slope_14 > 1e-9, false) THEN 1 ELSE 0 END)
    OVER ({_S}, c ORDER BY run_date) AS BIGINT) AS climbing_days,
  (value - baseline) * 100 / NULLIF(baseline, 0) AS delta_pct
FROM (SELECT *,
  sum(CASE WHEN coalesce(value > day_before, false) THEN 0 ELSE 1 END)
    OVER ({_S} ORDER BY run_date) AS r,
  sum(CASE WHEN coalesce(slope_14 > 1e-9, false) THEN 0 ELSE 1 END)
    OVER ({_S} ORDER BY run_date) AS c FROM v_flags)"""
VIEWS["v_peers"] = """
SELECT s.*, m.peer_median, abs(s.value - m.peer_median) AS away
FROM v_series s JOIN (SELECT layer, expectation_type, column_name, run_date,
  quantile_cont(value, 0.5) AS peer_median FROM v_series GROUP BY ALL) m
ON s.layer = m.layer AND s.expectation_type = m.expectation_type AND s.run_date = m.run_date
  AND s.column_name IS NOT DISTINCT FROM m.column_name"""


def rule_sql(metric: str, severity: str, fires: str, base: str, delta: str, text: str,
             source: str = "v_trend") -> str:
    return f"""SELECT tenant_id, layer, expectation_type, column_name, run_date,
  '{metric}' AS metric, {severity} AS severity, round(value, 4) AS current_value,
  round({base}, 4) AS baseline_value, round({delta}, 4) AS delta_pct, '{text}' AS description
FROM {source} WHERE {fires}"""


def _change(base: str) -> str:
    return f"(value - {base}) * 100 / NULLIF({base}, 0)"


_VOLUME, _NULLS = f"expectation_type = '{Q.ROW_COUNT}'", f"expectation_type = '{Q.NOT_NULL}'"
_SHARES, _FORMAT = f"expectation_type <> '{Q.ROW_COUNT}'", f"expectation_type = '{Q.REGEX}'"
_EDGE = "(CASE WHEN value < lowest THEN lowest ELSE highest END)"

RULES = {
    "n01_key_null_rate": ("null_rate", rule_sql(
        "null_rate", "'sev1'", f"{_NULLS} AND column_name IN {sql_in(A.KEY_COLUMNS)} AND value > 20", "baseline", "delta_pct",
        "Null rate of a key column is too high")),
    "n02_volume_vs_week": ("volume_vs_week", rule_sql(
        "volume_vs_week", "'sev1'", f"{_VOLUME} AND abs(delta_pct) > 50", "baseline",
        "delta_pct", "Volume is far from its 7-day average")),
    "n02_w06_volume_day_drop": ("volume_day_drop", rule_sql(
        "volume_day_drop", "'sev1'", f"{_VOLUME} AND {_change('day_before')} < -50", "day_before",
        _change("day_before"), "Volume fell within one day")),
    "n03_null_rate_rising": ("null_rate_rising", rule_sql(
        "null_rate_rising", "'sev2'", f"{_NULLS} AND rising_days >= 7", "baseline", "delta_pct",
        "Null rate rose on 7 days in a row")),
    "n04_unexpected_share": ("unexpected_share", rule_sql(
        "unexpected_share", "'sev2'", f"{_SHARES} AND value > 10", "baseline", "delta_pct",
        "Too many unexpected values")),
    "n05_unexpected_trend": ("unexpected_trend", rule_sql(
        "unexpected_trend", "CASE WHEN climbing_days > 14 THEN 'sev2' ELSE 'sev3' END",
        f"{_SHARES} AND climbing_days > 0", "baseline", "delta_pct",
        "Unexpected values increase over 14 days")),
    "n06_volume_week_change": ("volume_week_change", rule_sql(
        "volume_week_change", "'sev2'", f"{_VOLUME} AND abs({_change('week_ago')}) > 20",
        "week_ago", _change("week_ago"), "Volume changed over 7 days")),
    "n07_format_drift": ("format_drift", rule_sql(
        "format_drift", "'sev2'", f"{_FORMAT} AND value - baseline > 5", "baseline", "delta_pct",
        "More values miss the expected format")),
    "n08_out_of_own_range": ("out_of_range", rule_sql(
        "out_of_range", "'sev3'", "value < lowest OR value > highest", _EDGE, _change(_EDGE),
        "Value outside its own 14-day range")),
}


def _register(name: str, metric: str, sql: str) -> None:
    @query(name, sql)
    def _(t):
        return A.series_anomalies(history(t)).filter(F.col("metric") == metric)


for _name, (_metric, _sql) in RULES.items():
    _register(_name, _metric, _sql)

VIEWS["v_far"] = """
SELECT p.*, peer_mad FROM v_peers p JOIN (SELECT layer, expectation_type, column_name, run_date,
  quantile_cont(away, 0.5) AS peer_mad FROM v_peers GROUP BY ALL) d
ON p.layer = d.layer AND p.expectation_type = d.expectation_type AND p.run_date = d.run_date
  AND p.column_name IS NOT DISTINCT FROM d.column_name"""
_PEERS = rule_sql(
    "tenant_divergence", "'sev3'", "peer_mad > 1e-9 AND away > peer_mad * (3 * 1.4826::DOUBLE)",
    "peer_median", _change("peer_median"), "Tenant differs from the platform baseline", "v_far")


@query("n09_tenant_divergence", _PEERS)
def _(t):
    return A.peer_anomalies(history(t))


@query("q15_history_per_day", "SELECT * FROM v_history")
def _(t):
    return history(t)


_KEYS = "tenant_id, layer, expectation_type, column_name, run_date"


@query("w03_trailing_week_average", f"""
SELECT {_KEYS}, value, round(baseline, 6) AS baseline, round(delta_pct, 6) AS delta_pct
FROM v_trend""")
def _(t):
    return A.trend_figures(history(t)).select(
        *A.SERIES, "run_date", "value", F.round("baseline", 6).alias("baseline"),
        F.round("delta_pct", 6).alias("delta_pct"))


@query("w04_rising_run_length", f"SELECT {_KEYS}, rising_days FROM v_trend")
def _(t):
    return A.trend_figures(history(t)).select(*A.SERIES, "run_date", "rising_days")


@query("w05_two_week_slope", f"""
SELECT {_KEYS}, round(slope_14, 6) AS slope_14, climbing_days FROM v_trend""")
def _(t):
    return A.trend_figures(history(t)).select(
        *A.SERIES, "run_date", F.round("slope_14", 6).alias("slope_14"), "climbing_days")


@query("w06_filled_calendar", f"SELECT {_KEYS}, value, day_before FROM v_trend")
def _(t):
    return A.trend_figures(history(t)).select(*A.SERIES, "run_date", "value", "day_before")


_ALL = "\nUNION ALL\n".join([sql for _, sql in RULES.values()] + [_PEERS])


@query("n10_all_anomalies", _ALL)
def _(t):
    return A.detect(history(t))


@query("n11_o05_active_history", f"""
SELECT h.* FROM v_history h SEMI JOIN (SELECT 'unit-' || (user_id % 50) AS tenant_id FROM events
  GROUP BY 1 HAVING max(value) > 250) a USING (tenant_id)
WHERE run_date >= DATE '{AS_OF}' - 30""")
def _(t):
    return A.active_history(history(t), fine_registry(t), AS_OF)


@query("n12_p22_alert_routing", f"""
SELECT tenant_id, run_date, metric, column_name, severity, severity IN ('sev1', 'sev2')
  AS to_alerts, severity = 'sev1' AS to_remediation,
  CASE WHEN severity IN ('sev1', 'sev2') THEN '#dq-' || tenant_id END AS channel
FROM ({_ALL})""")
def _(t):
    return A.route(A.detect(history(t))).select(
        "tenant_id", "run_date", "metric", "column_name", "severity", "to_alerts",
        "to_remediation", "channel")


@query("n12_alert_deliveries", f"""
SELECT tenant_id, run_date, metric, column_name, severity, '#dq-' || tenant_id AS channel
FROM ({_ALL}) WHERE severity IN ('sev1', 'sev2')
UNION ALL
SELECT tenant_id, run_date, metric, column_name, severity, '#platform-alerts' AS channel
FROM ({_ALL}) WHERE severity = 'sev1'""")
def _(t):
    return A.deliveries(A.detect(history(t))).select("tenant_id", "run_date", "metric", "column_name", "severity", "channel")


@query("p22_alert_text", """
SELECT tenant_id, run_date, column_name,
  printf('%s %s alert for %s' || chr(10) || '%s %s is %.2f, usually %.2f (%+.1f%%)' || chr(10) || '%s',
    CASE WHEN success THEN ':warning:' ELSE ':rotating_light:' END,
    CASE WHEN success THEN 'SEV2' ELSE 'SEV1' END, tenant_id, layer, 'rows',
    observed_value, expected_value, observed_value - expected_value, expectation_type) AS message
FROM v_history""")
def _(t):
    from stratalake.functions.scalars import alert_text
    rows = history(t).withColumn("severity", F.when(F.col("success"), "sev2").otherwise("sev1"))
    rows = rows.withColumn("metric", F.lit("rows")).withColumn(
        "delta", F.col("observed_value") - F.col("expected_value"))
    return rows.select("tenant_id", "run_date", "column_name", alert_text(
        "severity", "tenant_id", "layer", "metric", "observed_value", "expected_value", "delta",
        "expectation_type").alias("message"))


@query("n13_gold_volume_threshold", """
WITH daily AS (SELECT tenant_id, event_date AS run_date, sum(event_count) AS events FROM v_kpi
  GROUP BY ALL),
gold AS (SELECT tenant_id, 'gold' AS layer, run_date, CAST(coalesce(events, 0) AS DOUBLE) AS value
  FROM (SELECT tenant_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS run_date
    FROM (SELECT tenant_id, min(run_date) AS lo, max(run_date) AS hi FROM daily GROUP BY ALL))
  LEFT JOIN daily USING (tenant_id, run_date)),
based AS (SELECT *, avg(value) OVER (PARTITION BY tenant_id ORDER BY run_date
    RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING) AS baseline FROM gold)
SELECT tenant_id, layer, run_date, value AS current_value, round(baseline, 4) AS baseline_value,
  round((value - baseline) * 100 / NULLIF(baseline, 0), 4) AS delta_pct FROM based
WHERE abs((value - baseline) * 100 / NULLIF(baseline, 0)) > 30""")
def _(t):
    from stratalake.plans import gold as G
    kpi = G.daily_kpi(t.silver, AS_OF, share_of_day=False)
    volume = kpi.groupBy("tenant_id", F.col("event_date").alias("run_date")).agg(
        F.sum("event_count").cast("double").alias("observed_value"))
    rows = volume.select(
        "tenant_id", "run_date", F.lit("gold").alias("layer"),
        F.lit(Q.ROW_COUNT).alias("expectation_type"),
        F.lit(None).cast("string").alias("column_name"), "observed_value",
        F.lit(None).cast("double").alias("unexpected_pct"))
    return A.series_anomalies(rows).filter(F.col("metric") == "volume_vs_week").select(
        "tenant_id", "layer", "run_date", "current_value", "baseline_value", "delta_pct")


_KIND = "CASE metric " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.REMEDIATION.items()) + " END"


@query("n14_remediation_choice", f"""
SELECT DISTINCT tenant_id, layer, metric, column_name, {_KIND} AS proposed_expectation
FROM ({_ALL}) WHERE severity = 'sev1'""")
def _(t):
    return A.proposals(A.detect(history(t)))


# The same rules over what a run of one day sees: active tenants, thirty days, nothing later.
VIEWS["v_seen_history"] = f"""
SELECT h.* FROM v_history h SEMI JOIN (SELECT 'unit-' || (user_id % 50) AS tenant_id FROM events
  GROUP BY 1 HAVING max(value) > 250) a USING (tenant_id)
WHERE run_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}'"""
_CHAIN = ("v_history", "v_series", "v_filled", "v_flags", "v_trend", "v_peers", "v_far")


def _seen(sql: str) -> str:
    return re.sub(r"\bv_(history|series|filled|flags|trend|peers|far)\b", r"v_seen_\1", sql)


for _name in _CHAIN[1:]:
    VIEWS[_seen(_name)] = _seen(VIEWS[_name])


@query("s10_alert_sink", f"""
SELECT tenant_id, layer, metric, severity, current_value, baseline_value, delta_pct, description,
  TIMESTAMP '{AS_OF}' AS detected_at, false AS resolved
FROM ({_seen(_ALL)}) WHERE run_date = DATE '{AS_OF}'""")
def _(t):
    path, rows = new_path(t.spark, "dq_alerts"), t.stored("dq_results", lambda: history(t), ())
    for _ in range(2):  # the second run finds its alerts in the table
        A.write_alerts(rows, fine_registry(t), AS_OF, path)
    return read_table(t.spark, path, S.DQ_ALERTS)
