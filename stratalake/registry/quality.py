"""Contract checks and model tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.operators import quality as Q
from stratalake.operators import silver as SV
from stratalake.plans import gold as G
from stratalake.registry.base import query, sql_pct
from stratalake.registry.layers import first_batch, silver_1, silver_2, silver_now, ts
from stratalake.registry.views import VIEWS, sql_in
from stratalake.session import new_path
from stratalake.sources.publish import append, read_table
from stratalake.sources.release import release, released
from stratalake.sources.tables import AS_OF, FIRST_RUN, SECOND_RUN

TENANTS = ["tenant-0", "tenant-1", "tenant-2", "tenant-3"]  # tenant-4 is not expected
GOOD_VENDOR = "^VND-[0-9]{2}$"


def rows_sql(source: str, expectation: str, column: str, bad: str, severity: str, layer: str,
             n: str = "count(*)") -> str:
    broken = f"CAST(sum(CASE WHEN {bad} THEN 1 ELSE 0 END) AS BIGINT)"
    return f"""SELECT tenant_id, '{expectation}' AS expectation_type, '{column}' AS column_name,
  '{severity}' AS severity, {broken} = 0 AS success, CAST({broken} AS DOUBLE) AS observed_value,
  CAST(0 AS DOUBLE) AS expected_value, {broken} AS unexpected_count,
  {broken} * 100::DOUBLE / {n} AS unexpected_pct, '{layer}' AS layer
FROM {source} GROUP BY tenant_id"""


def unique_sql(source: str, expectation: str, columns: str, severity: str, layer: str) -> str:
    keep = f"WHERE {columns} IS NOT NULL" if "," not in columns else ""
    keys = f"(SELECT tenant_id, {columns}, count(*) AS k FROM {source} {keep} GROUP BY ALL)"
    return f"""SELECT tenant_id, '{expectation}', '{columns.replace(' ', '')}', '{severity}',
  bad = 0, CAST(bad AS DOUBLE), CAST(0 AS DOUBLE), bad, bad * 100::DOUBLE / n, '{layer}'
FROM (SELECT tenant_id, CAST(sum(CASE WHEN k > 1 THEN k ELSE 0 END) AS BIGINT) AS bad,
  CAST(sum(k) AS BIGINT) AS n FROM {keys} GROUP BY tenant_id)"""


def count_sql(source: str, layer: str) -> str:
    return f"""SELECT tenant_id, '{Q.ROW_COUNT}', NULL, 'sev2', count(*) >= 1,
  CAST(count(*) AS DOUBLE), CAST(1 AS DOUBLE), NULL, NULL, '{layer}'
FROM {source} GROUP BY tenant_id"""


def max_sql(source: str, column: str, low: str, layer: str) -> str:
    return f"""SELECT tenant_id, '{Q.COLUMN_MAX}' AS expectation_type, '{column}' AS column_name,
  'sev1' AS severity, max({column}) >= {low} AS success,
  epoch_us(max({column})) / 1e6 AS observed_value, epoch_us({low}) / 1e6 AS expected_value,
  CAST(NULL AS BIGINT) AS unexpected_count, CAST(NULL AS DOUBLE) AS unexpected_pct,
  '{layer}' AS layer
FROM {source} GROUP BY tenant_id"""


def union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


VIEWS["v_kpi_share"] = "SELECT *, " + sql_pct(
    "event_count", "sum(event_count) OVER (PARTITION BY tenant_id, event_date)", 2
) + " AS pct_of_day FROM v_kpi"
VIEWS["v_funnel_rate"] = \
    f"SELECT *, {sql_pct('approved', 'total', 1)} AS approval_rate_pct FROM v_funnel"


@query("q01_not_null", union(
    rows_sql("v_silver_2", Q.NOT_NULL, "tenant_id", "tenant_id IS NULL", "sev1", "silver"),
    rows_sql("v_silver_2", Q.NOT_NULL, "event_id", "event_id IS NULL", "sev1", "silver"),
    rows_sql("v_silver_2", Q.NOT_NULL, "status", "status IS NULL", "sev2", "silver")))
def _(t):
    rules = [Q.not_null("tenant_id", "sev1"), Q.not_null("event_id", "sev1"),
             Q.not_null("status", "sev2")]
    return Q.evaluate(silver_2(t), rules, "silver")


@query("q02_values_in_set", union(
    rows_sql("v_typed", Q.IN_SET, "tenant_id", f"tenant_id NOT IN {sql_in(TENANTS)}",
             "sev1", "bronze"),
    rows_sql("v_typed", Q.IN_SET, "status", f"status NOT IN {sql_in(S.CONTRACT_STATUSES)}",
             "sev2", "bronze")))
def _(t):
    rules = [Q.in_set("tenant_id", TENANTS, "sev1"),
             Q.in_set("status", S.CONTRACT_STATUSES, "sev2")]
    return Q.evaluate(SV.silver_projection(t.bronze()), rules, "bronze")


@query("q02_tenants_of_the_registry", """
WITH active AS (SELECT 'unit-' || (user_id % 50) AS tenant_id FROM events GROUP BY 1 HAVING max(value) > 250)
SELECT b.tenant_id, 'relationships' AS expectation_type, 'tenant_id' AS column_name, 'sev1' AS severity,
  a.tenant_id IS NOT NULL AS success, CASE WHEN a.tenant_id IS NULL THEN n ELSE 0 END::DOUBLE AS observed_value,
  CAST(0 AS DOUBLE) AS expected_value, CASE WHEN a.tenant_id IS NULL THEN n ELSE 0 END AS unexpected_count,
  CASE WHEN a.tenant_id IS NULL THEN 100 ELSE 0 END::DOUBLE AS unexpected_pct, 'bronze' AS layer
FROM (SELECT tenant_id, count(*) AS n FROM v_fine_bronze GROUP BY tenant_id) b LEFT JOIN active a USING (tenant_id)""")
def _(t):
    """Rows of tenants that the registry does not hold as active, of any number of tenants."""
    active = t.raw("events").groupBy(F.concat(F.lit("unit-"), F.col("user_id") % 50).alias("tenant_id")).agg(
        F.max("value").alias("v")).filter("v > 250").select("tenant_id")
    return Q.relationship(t.bronze("fine"), active, ("tenant_id",), "tenant_id", "bronze")


_UNIQUE_COLUMNS = "SELECT * FROM ({}) AS r(tenant_id, expectation_type, column_name, severity, " \
    "success, observed_value, expected_value, unexpected_count, unexpected_pct, layer)"


@query("q03_column_unique", _UNIQUE_COLUMNS.format(union(
    unique_sql("v_bronze", Q.UNIQUE, "event_id", "sev2", "bronze"),
    unique_sql("v_silver", Q.UNIQUE, "event_id", "sev1", "silver"))))
def _(t):
    return Q.evaluate(t.bronze(), [Q.unique("event_id", "sev2")], "bronze").unionByName(
        Q.evaluate(t.silver, [Q.unique("event_id", "sev1")], "silver"))


@query("q04_values_between", union(
    rows_sql("v_bronze", Q.BETWEEN, "event_timestamp",
             f"event_timestamp < TIMESTAMP '{FIRST_RUN}' - INTERVAL 5 DAY OR "
             f"event_timestamp > TIMESTAMP '{FIRST_RUN}' + INTERVAL 1 DAY", "sev2", "bronze"),
    rows_sql("v_bronze", Q.BETWEEN, "_ingested_at",
             f"_ingested_at > TIMESTAMP '{AS_OF}'", "sev2", "bronze")))
def _(t):
    as_of = ts(FIRST_RUN)
    rules = [
        Q.between("event_timestamp", as_of - F.make_dt_interval(days=F.lit(5)),
                  Q.bounds(as_of)["tomorrow"], "sev2"),
        Q.between("_ingested_at", None, ts(AS_OF), "sev2"),
    ]
    return Q.evaluate(t.bronze(), rules, "bronze")


@query("q05_row_count_with_missing_tenants", f"""
SELECT tenant_id, '{Q.ROW_COUNT}' AS expectation_type, CAST(NULL AS VARCHAR) AS column_name,
  'sev2' AS severity, count(b.event_id) >= 1 AS success,
  CAST(count(b.event_id) AS DOUBLE) AS observed_value, CAST(1 AS DOUBLE) AS expected_value,
  CAST(NULL AS BIGINT) AS unexpected_count, CAST(NULL AS DOUBLE) AS unexpected_pct,
  'bronze' AS layer
FROM (SELECT tenant_id FROM v_registry UNION SELECT tenant_id FROM v_bronze)
LEFT JOIN v_bronze b USING (tenant_id) GROUP BY tenant_id""")
def _(t):
    tenants = t.registry().select("tenant_id").union(t.bronze().select("tenant_id"))
    return Q.evaluate(t.bronze(), [Q.row_count(1, None, "sev2")], "bronze",
                      expected_groups=tenants)


@query("q06_columns_match_set", f"""
SELECT tenant_id, '{Q.COLUMN_SET}' AS expectation_type, CAST(NULL AS VARCHAR) AS column_name,
  'sev2' AS severity, kind = 'superset' AS success, CAST(9 AS DOUBLE) AS observed_value,
  CAST(CASE kind WHEN 'superset' THEN 9 ELSE 10 END AS DOUBLE) AS expected_value,
  CAST(CASE kind WHEN 'superset' THEN 0 ELSE 7 END AS BIGINT) AS unexpected_count,
  CAST(NULL AS DOUBLE) AS unexpected_pct, kind AS layer
FROM (SELECT DISTINCT tenant_id, unnest(['superset', 'exact']) AS kind FROM v_bronze)""")
def _(t):
    rows = t.bronze()
    superset = [Q.columns_match(S.BRONZE_EVENTS.fieldNames(), "sev2")]
    exact = [Q.columns_match(S.SILVER_EVENTS.fieldNames(), "sev2", exact=True)]
    # Bronze lacks four Silver columns and has three of its own.
    return Q.evaluate(rows, superset, "superset").unionByName(
        Q.evaluate(rows, exact, "exact"))


@query("q07_compound_unique", _UNIQUE_COLUMNS.format(union(
    unique_sql("v_kpi", Q.COMPOUND_UNIQUE, "event_date, event_type, status", "sev1", "gold"),
    unique_sql("v_typed", Q.COMPOUND_UNIQUE, "reference_id, event_type, status", "sev1",
               "silver"))))
def _(t):
    kpi = G.daily_kpi(t.silver, AS_OF, share_of_day=False)
    gold = Q.evaluate(
        kpi, [Q.compound_unique(["event_date", "event_type", "status"], "sev1")], "gold")
    typed = Q.evaluate(
        SV.silver_projection(t.bronze()),
        [Q.compound_unique(["reference_id", "event_type", "status"], "sev1")], "silver")
    return gold.unionByName(typed)


@query("q08_freshness", union(
    max_sql("v_silver_2", "last_updated_at",
            f"(TIMESTAMP '{SECOND_RUN}' - INTERVAL 26 HOUR)", "silver"),
    max_sql("v_silver_1", "last_updated_at",
            f"(TIMESTAMP '{SECOND_RUN}' - INTERVAL 26 HOUR)", "silver")))
def _(t):
    rules = [Q.column_max("last_updated_at", Q.bounds(ts(SECOND_RUN))["stale_before"], "sev1")]
    return Q.evaluate(silver_2(t), rules, "silver").unionByName(
        Q.evaluate(silver_1(t), rules, "silver"))


_REGEX = "NOT regexp_matches({}, '{}')"


@query("q09_values_match_regex", union(
    rows_sql("v_silver", Q.REGEX, "vendor_code", _REGEX.format("vendor_code", GOOD_VENDOR),
             "sev2", "silver"),
    rows_sql("v_silver", Q.REGEX, "reference_id",
             _REGEX.format("reference_id", "^R[0-9]+-[0-5]$"), "sev2", "silver")))
def _(t):
    typed = SV.silver_projection(t.bronze_first(), ("reference_id",), ("vendor_code",))
    return Q.evaluate(typed, [
        Q.matches("vendor_code", GOOD_VENDOR, "sev2"),
        Q.matches("reference_id", "^R[0-9]+-[0-5]$", "sev2")], "silver")


@query("q10_no_date_gaps", f"""
SELECT tenant_id, '{Q.NO_GAPS}' AS expectation_type, 'event_date' AS column_name,
  'sev1' AS severity, bad = 0 AS success, CAST(bad AS DOUBLE) AS observed_value,
  CAST(0 AS DOUBLE) AS expected_value, bad AS unexpected_count,
  bad * 100::DOUBLE / 7 AS unexpected_pct, 'gold' AS layer
FROM (SELECT tenant_id, 7 - count(DISTINCT event_date) FILTER (event_date BETWEEN
  DATE '2024-02-02' - 6 AND DATE '2024-02-02') AS bad FROM v_kpi GROUP BY tenant_id)""")
def _(t):
    kpi = G.daily_kpi(t.silver, AS_OF, share_of_day=False)
    return Q.no_date_gaps(kpi, "event_date", "2024-02-02", "gold")


@query("w08_missing_dates", """
SELECT tenant_id, missing_date FROM (SELECT DISTINCT tenant_id FROM v_kpi)
CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '2024-02-02' - 6, DATE '2024-02-02',
  INTERVAL 1 DAY)) AS DATE) AS missing_date)
ANTI JOIN (SELECT tenant_id, event_date AS missing_date FROM v_kpi)
USING (tenant_id, missing_date)""")
def _(t):
    kpi = G.daily_kpi(t.silver, AS_OF, share_of_day=False)
    return Q.date_gaps(kpi, "event_date", "2024-02-02")


@query("q11_silver_relates_to_bronze", f"""
SELECT tenant_id, 'relationships' AS expectation_type, 'event_id' AS column_name,
  'sev1' AS severity, bad = 0 AS success, CAST(bad AS DOUBLE) AS observed_value,
  CAST(0 AS DOUBLE) AS expected_value, bad AS unexpected_count,
  bad * 100::DOUBLE / n AS unexpected_pct, 'silver' AS layer
FROM (SELECT s.tenant_id, count(*) AS n, count(*) - count(b.event_id) AS bad
  FROM v_silver s LEFT JOIN (SELECT DISTINCT tenant_id, event_id FROM v_bronze
    WHERE _ingested_at <= TIMESTAMP '{FIRST_RUN}') b
  ON s.tenant_id = b.tenant_id AND s.event_id = b.event_id GROUP BY s.tenant_id)""")
def _(t):
    return Q.relationship(t.silver, first_batch(t), SV.KEYS, "event_id", "silver")


_KPI_TESTS = union(
    rows_sql("v_kpi_share", Q.NOT_NULL, "event_date", "event_date IS NULL", "sev1", "kpi_summary"),
    rows_sql("v_kpi_share", Q.NOT_NULL, "event_count", "event_count IS NULL", "sev1",
             "kpi_summary"),
    rows_sql("v_kpi_share", Q.EXPRESSION, "event_count", "event_count < 0", "sev1", "kpi_summary"),
    rows_sql("v_kpi_share", Q.EXPRESSION, "pct_of_day", "pct_of_day NOT BETWEEN 0 AND 100",
             "sev1", "kpi_summary"),
    unique_sql("v_kpi_share", Q.COMPOUND_UNIQUE, "event_date, event_type, status", "sev1",
               "kpi_summary"))


@query("q12_kpi_model_tests", _KPI_TESTS)
def _(t):
    return Q.evaluate(G.daily_kpi(t.silver, AS_OF), Q.kpi_model_tests(), "kpi_summary")


@query("q13_accepted_values", union(
    rows_sql("v_typed", Q.IN_SET, "status", f"status NOT IN {sql_in(S.MODEL_STATUSES)}", "sev1",
             "silver"),
    rows_sql("v_typed", Q.IN_SET, "event_type", "event_type NOT IN ('submission', 'review')",
             "sev1", "silver")))
def _(t):
    return Q.evaluate(SV.silver_projection(t.bronze()), [
        Q.in_set("status", S.MODEL_STATUSES, "sev1"),
        Q.in_set("event_type", ["submission", "review"], "sev1")], "silver")


@query("q13_silver_source_tests", union(
    rows_sql("v_silver_2", Q.NOT_NULL, "tenant_id", "tenant_id IS NULL", "sev1", "silver"),
    rows_sql("v_silver_2", Q.NOT_NULL, "event_id", "event_id IS NULL", "sev1", "silver"),
    unique_sql("v_silver_2", Q.UNIQUE, "event_id", "sev1", "silver"),
    rows_sql("v_silver_2", Q.NOT_NULL, "event_timestamp", "event_timestamp IS NULL", "sev1", "silver"),
    rows_sql("v_silver_2", Q.IN_SET, "status", f"status NOT IN {sql_in(S.MODEL_STATUSES)}", "sev1", "silver")))
def _(t):
    return Q.evaluate(silver_now(t), Q.silver_source_tests(), "silver")


@query("q14_cycle_and_funnel_model_tests", union(
    rows_sql("v_cycle", Q.NOT_NULL, "reference_id", "reference_id IS NULL", "sev1", "cycle_time"),
    rows_sql("v_cycle", Q.EXPRESSION, "cycle_days", "cycle_days < 0", "sev1", "cycle_time"),
    rows_sql("v_cycle", Q.IN_SET, "final_status", f"final_status NOT IN {sql_in(S.OUTCOMES)}",
             "sev1", "cycle_time"),
    unique_sql("v_cycle", Q.UNIQUE, "reference_id", "sev1", "cycle_time"),
    rows_sql("v_funnel_rate", Q.NOT_NULL, "week_start", "week_start IS NULL", "sev1",
             "approval_funnel"),
    rows_sql("v_funnel_rate", Q.EXPRESSION, "approval_rate_pct",
             "approval_rate_pct NOT BETWEEN 0 AND 100", "sev1", "approval_funnel"),
    unique_sql("v_funnel_rate", Q.UNIQUE, "week_start", "sev1", "approval_funnel")))
def _(t):
    cycles = Q.evaluate(G.cycle_time(t.silver), Q.cycle_model_tests(), "cycle_time")
    funnel = Q.evaluate(
        G.approval_funnel(t.silver, AS_OF), Q.funnel_model_tests(), "approval_funnel")
    return cycles.unionByName(funnel)




def _bronze_contract_sql(recency: bool) -> str:
    day = f"TIMESTAMP '{AS_OF}'"
    parts = [
        rows_sql("v_bronze", Q.NOT_NULL, "tenant_id", "tenant_id IS NULL", "sev1", "bronze"),
        rows_sql("v_bronze", Q.NOT_NULL, "event_id", "event_id IS NULL", "sev1", "bronze"),
        rows_sql("v_bronze", Q.NOT_NULL, "event_timestamp", "event_timestamp IS NULL", "sev1",
                 "bronze"),
        rows_sql("v_bronze", Q.IN_SET, "tenant_id", f"tenant_id NOT IN {sql_in(TENANTS)}", "sev1",
                 "bronze"),
        unique_sql("v_bronze", Q.UNIQUE, "event_id", "sev2", "bronze"),
        count_sql("v_bronze", "bronze"),
        f"""SELECT tenant_id, '{Q.COLUMN_SET}', NULL, 'sev2', true, CAST(9 AS DOUBLE),
          CAST(9 AS DOUBLE), 0, NULL, 'bronze' FROM v_bronze GROUP BY tenant_id""",
    ]
    if recency:
        parts.append(rows_sql(
            "v_bronze", Q.BETWEEN, "event_timestamp",
            f"event_timestamp < {day} - INTERVAL 90 DAY OR event_timestamp > {day} + INTERVAL 1 DAY",
            "sev2", "bronze"))
    return union(*parts)


_RESULTS = """SELECT tenant_id, DATE '{day}' AS run_date, layer, expectation_type, column_name,
  success, observed_value, expected_value, unexpected_count, unexpected_pct FROM ({rows})"""


@query("q15_q16_bronze_contract_results",
       _RESULTS.format(day=AS_OF, rows=_bronze_contract_sql(True)))
def _(t):
    evaluated = Q.evaluate(t.bronze(), Q.bronze_contract(ts(AS_OF), TENANTS), "bronze")
    path = new_path(t.spark, "dq_results")
    # One run has a few rows per tenant: a single run_date folder, not one per tenant.
    append(Q.to_dq_results(evaluated, F.lit(AS_OF).cast("date")), path, ("run_date",))
    return read_table(t.spark, path, S.DQ_RESULTS)


@query("q17_backfill_skips_recency", _bronze_contract_sql(False))
def _(t):
    return Q.evaluate(t.bronze(), Q.bronze_contract(ts(AS_OF), TENANTS), "bronze", backfill=True)


_SILVER_CONTRACT = union(
    rows_sql("v_silver_2", Q.NOT_NULL, "tenant_id", "tenant_id IS NULL", "sev1", "silver"),
    rows_sql("v_silver_2", Q.NOT_NULL, "event_id", "event_id IS NULL", "sev1", "silver"),
    rows_sql("v_silver_2", Q.NOT_NULL, "event_timestamp", "event_timestamp IS NULL", "sev1",
             "silver"),
    rows_sql("v_silver_2", Q.NOT_NULL, "status", "status IS NULL", "sev2", "silver"),
    rows_sql("v_silver_2", Q.IN_SET, "status", f"status NOT IN {sql_in(S.CONTRACT_STATUSES)}",
             "sev2", "silver"),
    max_sql("v_silver_2", "last_updated_at",
            f"(TIMESTAMP '{SECOND_RUN}' - INTERVAL 26 HOUR)", "silver"),
    unique_sql("v_silver_2", Q.UNIQUE, "event_id", "sev1", "silver"),
    rows_sql("v_silver_2", Q.BETWEEN, "event_timestamp",
             f"event_timestamp > TIMESTAMP '{SECOND_RUN}' + INTERVAL 1 DAY", "sev2", "silver"))


@query("q15_silver_contract_results", _SILVER_CONTRACT)
def _(t):
    return Q.evaluate(silver_now(t), Q.silver_contract(ts(SECOND_RUN)), "silver")


_GOLD_CONTRACT = union(
    rows_sql("v_kpi", Q.NOT_NULL, "event_date", "event_date IS NULL", "sev1", "gold"),
    rows_sql("v_kpi", Q.NOT_NULL, "event_count", "event_count IS NULL", "sev1", "gold"),
    rows_sql("v_kpi", Q.BETWEEN, "event_count", "event_count < 0", "sev1", "gold"),
    unique_sql("v_kpi", Q.COMPOUND_UNIQUE, "event_date, event_type, status", "sev1", "gold"),
    max_sql(f"(SELECT *, TIMESTAMP '{AS_OF}' AS refreshed_at FROM v_kpi)", "refreshed_at",
            f"TIMESTAMP '{AS_OF}'", "gold"),
    count_sql("v_kpi", "gold"))


@query("q15_gold_contract_results", _GOLD_CONTRACT)
def _(t):
    kpi = G.daily_kpi(t.silver, AS_OF, share_of_day=False).withColumn("refreshed_at", ts(AS_OF))
    return Q.evaluate(kpi, Q.gold_contract(ts(AS_OF)), "gold")


@query("s07_gold_write_audit_publish", f"""
SELECT 'kpi_summary' AS model, tenant_id, CAST(event_date AS VARCHAR) || '/' || event_type || '/' || coalesce(status, '') AS key,
  CAST(event_count AS DOUBLE) AS value, TIMESTAMP '{AS_OF}' AS refreshed_at FROM v_kpi
UNION ALL SELECT 'cycle_time', tenant_id, reference_id, CAST(cycle_days AS DOUBLE), TIMESTAMP '{AS_OF}' FROM v_cycle
UNION ALL SELECT 'approval_funnel', tenant_id, CAST(week_start AS VARCHAR), CAST(total AS DOUBLE), TIMESTAMP '{AS_OF}' FROM v_funnel""")
def _(t):
    root, silver = new_path(t.spark, "gold"), t.stored("silver_rows", lambda: t.silver)
    models = {
        "kpi_summary": (G.daily_kpi(silver, AS_OF, share_of_day=False), ("tenant_id", "event_date"), Q.gold_contract(ts(AS_OF))),
        "cycle_time": (G.cycle_time(silver), ("tenant_id",), Q.cycle_model_tests()),
        "approval_funnel": (G.approval_funnel(silver, AS_OF), ("tenant_id",), Q.funnel_model_tests())}
    release(root, "first", models, ts(AS_OF))
    # The next release has a model that breaks its contract, so none of its tables is seen.
    kpi, by, rules = models["kpi_summary"]
    broken = {**models, "kpi_summary": (kpi.withColumn("event_count", -F.col("event_count")), by, rules)}
    release(root, "second", broken, ts(SECOND_RUN))
    keys = {"kpi_summary": ("event_count", ["event_date", "event_type", "status"]), "cycle_time": ("cycle_days", ["reference_id"]),
            "approval_funnel": ("total", ["week_start"])}
    out = None
    for model, (value, key) in keys.items():
        schema = models[model][0].withColumn("refreshed_at", ts(AS_OF)).schema
        rows = released(t.spark, root, model, schema).select(
            F.lit(model).alias("model"), "tenant_id", F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]).alias("key"),
            F.col(value).cast("double").alias("value"), "refreshed_at")
        out = rows if out is None else out.unionByName(rows)
    return out


_PASSED = "sum(CASE WHEN success THEN 1 ELSE 0 END)"


@query("q18_pass_rates", f"""
SELECT tenant_id, layer, severity, count(*) AS checks, {sql_pct(_PASSED, 'count(*)', 2)}
  AS pass_rate_pct, {sql_pct(f'(count(*) - {_PASSED})', 'count(*)', 2)} AS failure_rate_pct
FROM ({_SILVER_CONTRACT}) GROUP BY ALL""")
def _(t):
    evaluated = Q.evaluate(silver_now(t), Q.silver_contract(ts(SECOND_RUN)), "silver")
    return Q.pass_rates(evaluated, "tenant_id", "layer", "severity")
