"""Schema deviation, governance, promotion and changelog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.operators import changelog as C
from stratalake.operators import deviation as V
from stratalake.operators import governance as G
from stratalake.operators import lifecycle as L
from stratalake.operators import promotion as P
from stratalake.operators import quality as Q
from stratalake.operators import silver as SV
from stratalake.plans import gold
from stratalake.registry.base import query, sql_pct, sql_text
from stratalake.registry.layers import silver_1, silver_now, ts
from stratalake.registry.views import VIEWS, sql_case, sql_in, sql_list
from stratalake.session import new_path
from stratalake.sources.publish import append_once, read_table
from stratalake.sources.tables import FIRST_RUN, ORDERS_AS_OF, Tables


# --- Schema deviation -------------------------------------------------------------------
VIEWS["v_dev"] = f"""
SELECT 'tenant-' || (user_id % 5) AS tenant_id, event_id, event_type, event_timestamp,
  source_system, json_object(
    'status', CASE WHEN user_id % 5 = 3 THEN CAST(n % 7 AS VARCHAR) ELSE status0 END,
    'reference_id', CASE WHEN user_id % 5 <> 2 THEN ref END,
    'due_date', CASE WHEN user_id % 5 = 0 THEN strftime(event_timestamp, '%Y-%m-%d') END,
    'priority', CASE user_id % 5 WHEN 2 THEN CAST(n % 10 AS VARCHAR) WHEN 4 THEN 'P' || (n % 10) END,
    'closed_at', CASE WHEN user_id % 5 = 3 THEN
      strftime(event_timestamp, '%Y-%m-%d') || ' 10:30:00' END,
    'amount_usd', CASE WHEN user_id % 5 = 3 THEN value END) AS payload
FROM v_ev"""
VIEWS["v_dev_keys"] = """
SELECT tenant_id, key AS field, payload ->> ('$.' || key) AS text
FROM (SELECT tenant_id, payload, unnest(json_keys(payload)) AS key FROM v_dev)
WHERE payload ->> ('$.' || key) IS NOT NULL"""
VIEWS["v_fields"] = """
SELECT tenant_id, field, CASE
  WHEN bool_and(regexp_full_match(text, '[+-]?[0-9]{1,18}')) THEN 'BIGINT'
  WHEN bool_and(try_cast(text AS DOUBLE) IS NOT NULL) THEN 'DOUBLE'
  WHEN bool_and(regexp_full_match(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) THEN 'DATE'
  WHEN bool_and(regexp_matches(text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T]')
    AND try_cast(text AS TIMESTAMP) IS NOT NULL) THEN 'TIMESTAMP'
  ELSE 'STRING' END AS type
FROM v_dev_keys GROUP BY ALL
UNION ALL
SELECT tenant_id, f, CASE f WHEN 'event_timestamp' THEN 'TIMESTAMP' ELSE 'STRING' END
FROM (SELECT DISTINCT tenant_id FROM v_dev),
  unnest(['event_id', 'event_type', 'event_timestamp', 'source_system']) u(f)"""


def _deviations_sql(standard: list[str]) -> str:
    types = sql_case("field", S.EXPECTED_TYPES)
    return f"""
SELECT tenant_id, field, 'extra' AS kind, NULL AS expected, type AS actual FROM v_fields
WHERE field NOT IN {sql_in(S.STANDARD_FIELDS)}
UNION ALL
SELECT tenant_id, field, 'missing', {types}, NULL
FROM (SELECT tenant_id, unnest({sql_list(standard)}) AS field
  FROM (SELECT DISTINCT tenant_id FROM v_fields))
ANTI JOIN v_fields USING (tenant_id, field)
UNION ALL
SELECT tenant_id, field, 'type_mismatch', {types}, type FROM v_fields
WHERE type <> {types}"""


VIEWS["v_deviations"] = _deviations_sql(
    [f for f in S.STANDARD_FIELDS if f not in S.PLATFORM_FIELDS])


def fields(t: Tables) -> DataFrame:
    return V.source_fields(t.bronze_deviating())


@query("v06_precise_field_types", "SELECT * FROM v_fields")
def _(t):
    return fields(t)


@query("v01_v02_u03_deviations", "SELECT * FROM v_deviations")
def _(t):
    return V.deviations(fields(t))


@query("v01_deviations_from_merged_profile", "SELECT * FROM v_deviations")
def _(t):
    """The profile of Bronze from three loads, each profiled when it came."""
    path, bronze = new_path(t.spark, "field_profile"), t.bronze_deviating()
    for part in range(3):
        load = bronze.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part)
        append_once(V.field_profile(load), path, f"load-{part}", ())
    return V.deviations(V.profile_fields(V.merged_profile(read_table(t.spark, path, V.field_profile(bronze).schema))))


@query("v01_deviations_with_platform_fields", _deviations_sql(S.STANDARD_FIELDS))
def _(t):
    return V.deviations(fields(t), platform_fields=True)


def _names(kind: str) -> str:
    return f"coalesce(string_agg(field, ',' ORDER BY field) FILTER (kind = '{kind}'), '')"


@query("v01_deviation_reports", f"""
SELECT tenant_id, {_names('extra')} AS extra_fields, {_names('missing')} AS missing_fields,
  {_names('type_mismatch')} AS type_mismatches
FROM v_deviations GROUP BY tenant_id""")
def _(t):
    return V.reports(V.deviations(fields(t)))


@query("v03_deviation_flags", """
SELECT tenant_id, count(field) AS deviations, count(field) > 0 AS has_deviation
FROM (SELECT DISTINCT tenant_id FROM v_dev) LEFT JOIN v_deviations USING (tenant_id)
GROUP BY tenant_id""")
def _(t):
    return V.deviation_flags(t.bronze_deviating(), V.deviations(fields(t)))


@query("v04_adaptive_silver", """
SELECT tenant_id, event_id, event_type, event_timestamp, source_system,
  payload ->> '$.status' AS status, payload ->> '$.reference_id' AS reference_id,
  try_cast(payload ->> '$.amount_usd' AS DOUBLE) AS amount_usd,
  try_cast(payload ->> '$.closed_at' AS TIMESTAMP) AS closed_at,
  try_cast(payload ->> '$.due_date' AS DATE) AS due_date, payload ->> '$.priority' AS priority
FROM v_dev""")
def _(t):
    bronze = t.bronze_deviating()
    adapted = V.adapted_silver(bronze, V.deviations(V.source_fields(bronze)))
    return adapted.select(
        "tenant_id", "event_id", "event_type", "event_timestamp", "source_system", "status", "reference_id",
        *[F.expr(f"try_variant_get(extras['{name}'], '$', '{kind}')").alias(name) for name, kind in (
            ("amount_usd", "double"), ("closed_at", "timestamp"), ("due_date", "date"), ("priority", "string"))])


@query("v05_custom_states", f"""
SELECT tenant_id, status, count(*) AS events FROM v_typed
WHERE status NOT IN {sql_in(S.CONTRACT_STATUSES)} GROUP BY ALL""")
def _(t):
    return V.custom_states(SV.silver_projection(t.bronze()))


# --- Governance -------------------------------------------------------------------------
VIEWS["v_entitled"] = """
SELECT 'sp-tenant-' || replace(tenant_id, '-', '_') AS principal, tenant_id
FROM (SELECT DISTINCT tenant_id FROM v_bronze)
UNION ALL
SELECT 'auditor', tenant_id FROM v_bronze_first WHERE event_type = 'decision'
GROUP BY tenant_id HAVING count(*) > (SELECT avg(n) FROM (SELECT tenant_id, count(*) AS n
  FROM v_bronze_first WHERE event_type = 'decision' GROUP BY ALL))"""


def entitlements(t: Tables) -> DataFrame:
    """Each tenant's own principal, and an auditor for tenants with many decisions."""
    own = t.bronze_first().groupBy("tenant_id").agg(
        F.count_if(F.col("event_type") == "decision").alias("n"))
    principal = F.concat(F.lit("sp-tenant-"), F.translate("tenant_id", "-", "_"))
    mean = own.agg(F.avg("n"))
    rows = own.select(principal.alias("principal"), "tenant_id").unionByName(
        own.filter(F.col("n") > mean.scalar()).select(F.lit("auditor").alias("principal"),
                                                      "tenant_id"))
    return t.stored("entitlements", lambda: rows)


@query("g01_row_filter", """
SELECT tenant_id, event_id, event_type, status FROM v_silver
WHERE tenant_id IN (SELECT tenant_id FROM v_entitled WHERE principal = 'auditor')""")
def _(t):
    table = t.stored("silver", lambda: t.silver, ("tenant_id",))
    return G.visible_rows(table, entitlements(t), "auditor").select(
        "tenant_id", "event_id", "event_type", "status")


@query("g16_isolation_check", """
SELECT principal, tenant_id, count(*) AS leaked_rows
FROM (SELECT tenant_id, 'sp-tenant-tenant_' || CASE WHEN source_system = 'batch-file'
  THEN (CAST(right(tenant_id, 1) AS INT) + 1) % 5 ELSE CAST(right(tenant_id, 1) AS INT) END
  AS principal FROM v_silver)
ANTI JOIN v_entitled USING (principal, tenant_id) GROUP BY ALL""")
def _(t):
    # A feed that hands one source's rows to the wrong principal.
    index = F.right("tenant_id", F.lit(1)).cast("int")
    wrong = F.col("source_system") == "batch-file"
    principal = F.concat(F.lit("sp-tenant-tenant_"),
                         F.when(wrong, (index + 1) % 5).otherwise(index))
    return G.isolation_violations(t.silver.withColumn("principal", principal), entitlements(t))


_GRANTS = "SELECT tenant_id, privilege, object_type, replace(o, '{t}', t) AS object_name, " \
    "replace(p, '{t}', t) AS principal FROM (SELECT tenant_id, replace(tenant_id, '-', '_') AS t " \
    "FROM v_registry), (VALUES " + ", ".join(str(r) for r in G.GRANT_MATRIX) + \
    ") g(privilege, object_type, o, p)"


@query("g02_grant_statements", f"""
SELECT *, 'GRANT ' || privilege || ' ON ' || object_type || ' main.' || object_name || ' TO `' ||
  principal || '`' AS statement FROM ({_GRANTS})""")
def _(t):
    return G.grant_rows(t.registry(), "main")


@query("g02_grant_outcome", f"""
SELECT tenant_id, count(*) FILTER (state = 'ACTIVE' AND principal LIKE 'sp-%') AS applied,
  count(*) FILTER (NOT (state = 'ACTIVE' AND principal LIKE 'sp-%')) AS skipped,
  count(*) FILTER (state = 'ACTIVE' AND principal LIKE 'sp-%') || ' applied, ' ||
  count(*) FILTER (NOT (state = 'ACTIVE' AND principal LIKE 'sp-%')) || ' skipped' AS description
FROM ({_GRANTS}) JOIN v_registry USING (tenant_id) GROUP BY tenant_id""")
def _(t):
    # Service principals exist for active tenants; analyst groups were never created.
    known = t.registry().filter(F.col("state") == "ACTIVE").select(
        F.concat(F.lit("sp-tenant-"), F.translate("tenant_id", "-", "_")).alias("principal"))
    return G.grant_summary(G.grant_outcome(G.grant_rows(t.registry(), "main"), known))


VIEWS["v_policies"] = """
SELECT 'table_' || (o_custkey % 400) AS table_name, 'policy ' || o_orderkey AS policy_body,
  o_orderdate AS created_at, o_orderstatus = 'O' AS is_current FROM orders"""


@query("g03_previous_policy", """
SELECT table_name, policy_body, created_at FROM v_policies WHERE NOT is_current
QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY created_at DESC, policy_body) = 1""")
def _(t):
    policies = t.raw("orders").select(
        F.concat(F.lit("table_"), F.col("o_custkey") % 400).alias("table_name"),
        F.concat(F.lit("policy "), F.col("o_orderkey")).alias("policy_body"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderstatus") == "O").alias("is_current"))
    return G.previous_state(policies, ["table_name"], [F.desc("created_at"), F.col("policy_body")]
                            ).drop("is_current")


@query("g03_grants_after_deployment", """
SELECT tenant_id, change_timestamp, description FROM v_log
WHERE change_type = 'PIPELINES_SCAFFOLDED' AND change_timestamp > TIMESTAMP '2001-01-01'""")
def _(t):
    kind = t.change_log().filter(F.col("change_type") == "PIPELINES_SCAFFOLDED")
    return G.changes_after(kind, "change_timestamp", ts("2001-01-01")).select(
        "tenant_id", "change_timestamp", "description")


_PATH = [*S.STATES]
_LEGAL = " OR ".join(
    f"(from_state = '{a}' AND to_state IN ('{b}', 'FAILED'))" for a, b in zip(_PATH, _PATH[1:]))


@query("g04_transition_legality", f"""
SELECT *, {_LEGAL} AS legal FROM (SELECT tenant_id, changed_at, seq,
  lag(state) OVER (PARTITION BY tenant_id ORDER BY changed_at, seq) AS from_state,
  state AS to_state FROM v_state_log) WHERE from_state IS NOT NULL""")
def _(t):
    log = t.state_log()
    return G.transitions(log)


@query("g05_current_state", f"""
SELECT tenant_id, state, {sql_case("state", dict(zip(_PATH, _PATH[1:])))} AS next_state,
  state IN ('ACTIVE', 'FAILED') AS is_terminal FROM v_state_log
QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY changed_at DESC, seq DESC) = 1""")
def _(t):
    return G.current_states(t.state_log())


VIEWS["v_gold_schemas"] = """
SELECT DISTINCT 'gold_cust_' || o_custkey AS schema_name FROM orders WHERE o_totalprice > 400000"""


@query("g06_activation_gate", """
SELECT tenant_id, schema_name IS NOT NULL AS has_gold,
  CASE WHEN state = 'FAILED' THEN 0 ELSE 3 END::BIGINT AS active_contracts,
  schema_name IS NOT NULL AND state <> 'FAILED' AS can_activate,
  CASE WHEN schema_name IS NULL THEN 'gold schema missing' WHEN state = 'FAILED'
    THEN 'no active contract' END AS reason
FROM v_registry LEFT JOIN v_gold_schemas ON schema_name = 'gold_' || replace(tenant_id, '-', '_')""")
def _(t):
    registry = t.registry()
    schemas = t.raw("orders").filter(F.col("o_totalprice") > 400000).select(
        F.concat(F.lit("gold_cust_"), F.col("o_custkey")).alias("schema_name")).distinct()
    contracts = L.deactivate_contracts(
        L.contract_rows(registry, ts(ORDERS_AS_OF)), registry.filter(F.col("state") == "FAILED"))
    return G.activation_gate(registry, schemas, contracts)


# --- Change classification and promotion ------------------------------------------------
_ONBOARDING = "path IN ('orchestrator/handlers/register_tenant.py', " \
    "'orchestrator/handlers/provision_grants.py')"
_IN_SCOPE = {
    1: f"({_ONBOARDING} OR path IN ('orchestrator/handlers/scaffold_dashboards.py', "
       "'orchestrator/handlers/scaffold_quality.py', 'orchestrator/handlers/activate_tenant.py') "
       "OR starts_with(path, 'templates/dashboards/') "
       "OR starts_with(path, 'templates/quality_contracts/'))",
    2: "(path = 'templates/pipelines/gold_analytics.sql.j2' "
       "OR regexp_matches(path, '^(dbt/)?models/gold_.*/'))",
    3: "(regexp_matches(path, '^dbt/models/(bronze|silver|vault|feature_store)/') "
       "OR starts_with(path, 'orchestrator/'))",
    4: f"({_ONBOARDING} OR path IN ('AGENTS.md', 'promotion/categories.yml', 'databricks.yml') "
       "OR regexp_matches(path, '/.*[.](grants|rls)[.]sql$'))",
    5: "contains(path, '/')",
}


def _by_files_sql(ids: list[int]) -> str:
    flags = ", ".join(f"bool_or({_IN_SCOPE[i]}) AS c{i}" for i in ids)
    matched = "[x FOR x IN [" + ", ".join(f"CASE WHEN c{i} THEN {i} END" for i in ids) \
        + "] IF x IS NOT NULL]"
    return f"""
SELECT change_id, {sql_text('matched')} AS matched, CAST(CASE len(matched) WHEN 0 THEN 2 ELSE matched[-1] END AS INT)
    AS category_id,
  CASE len(matched) WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence,
  CASE WHEN len(matched) > 1 THEN 'Files of several categories changed: ' ||
    array_to_string(matched, ', ') || '. Category ' || matched[-1] || ' applies as the riskiest of them. ' ||
    'Unless they depend on each other, promote them one by one.' END
    AS ambiguity_note,
  list_has_any(matched, [3, 4]) AND list_has_any(matched, [1, 2]) AS recommend_split
FROM (SELECT change_id, {matched} AS matched FROM (SELECT change_id, {flags} FROM v_files
  GROUP BY change_id))"""


VIEWS["v_by_files"] = _by_files_sql([1, 2, 3, 4])


@query("g07_g15_u04_classify_by_files", "SELECT * FROM v_by_files")
def _(t):
    return P.classify_by_files(t.changed_files())


@query("g07_classify_by_files_literal", _by_files_sql([1, 2, 3, 4, 5]))
def _(t):
    return P.classify_by_files(t.changed_files(), literal=True)


VIEWS["v_by_rules"] = f"""
SELECT change_id, rule_no, CASE rule_no WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 3
    WHEN 5 THEN 4 WHEN 6 THEN 5 WHEN 7 THEN CASE WHEN tenants = 1 AND all_named THEN 2 ELSE 3 END
    WHEN 8 THEN 1 ELSE 2 END AS category_id,
  CASE rule_no WHEN 9 THEN 0.6 ELSE 0.95 END::DOUBLE AS confidence,
  CASE rule_no WHEN 6 THEN 'On-call senior engineer approval and a retroactive review within 48h '
    || 'are required' WHEN 9 THEN 'No rule matched' END AS note
FROM (SELECT change_id, CASE
    WHEN bool_or(path IN ('AGENTS.md', 'promotion/categories.yml')
      OR regexp_matches(path, '[.](grants|rls)[.]sql$')) THEN 1
    WHEN bool_or(path = 'databricks.yml') THEN 2
    WHEN bool_or(regexp_matches(path, '^dbt/models/(bronze|silver|vault|feature_store)/')
      OR regexp_matches(path, '^templates/pipelines/(bronze|silver|vault)_')) THEN 3
    WHEN bool_or(starts_with(path, 'orchestrator/') AND NOT {_ONBOARDING}) THEN 4
    WHEN bool_or({_ONBOARDING}) THEN 5
    WHEN bool_or(regexp_matches(title, '\\[(hotfix|emergency)\\]')) THEN 6
    WHEN bool_and(regexp_matches(path, '^(dbt/models/gold_.*/|agents/|templates/quality_contracts/)'))
      THEN 7
    WHEN bool_and(starts_with(path, 'templates/dashboards/') OR path IN
      ('orchestrator/handlers/scaffold_dashboards.py', 'orchestrator/handlers/activate_tenant.py'))
      THEN 8 ELSE 9 END AS rule_no,
    count(DISTINCT nullif(regexp_extract(path,
      '^(dbt/models/gold_|agents/|templates/quality_contracts/)([^/.]+)', 2), '')) AS tenants,
    true AS all_named
  FROM v_files JOIN v_changes USING (change_id) GROUP BY change_id)"""


@query("g08_classify_by_rules", "SELECT * FROM v_by_rules")
def _(t):
    return P.classify_by_rules(t.changed_files(), t.changes())


_CATEGORY_VALUES = ", ".join(
    f"({i}, '{name}', {sql_list(path)}, {sla}::DOUBLE, {hold}, {canary}, {wait}, "
    f"{'NULL' if review is None else review}, {window}, "
    f"{'NULL' if dq is None else dq}::DOUBLE, {'NULL' if rows is None else rows}::DOUBLE, "
    f"{str(drift).lower()}, '{book}')"
    for i, name, path, sla, hold, canary, wait, review, window, dq, rows, drift, book
    in P.CATEGORIES)
VIEWS["v_categories"] = f"""
SELECT * FROM (VALUES {_CATEGORY_VALUES}) c({", ".join(
    part.split()[0] for part in P.CATEGORY_COLUMNS.split(", "))})"""


@query("g09_category_attributes", "SELECT change_id, category_id, category_name, confidence, " + sql_text("promotion_path") + """
  AS promotion_path, sla_hours, rollback_runbook
FROM v_by_files JOIN v_categories USING (category_id)""")
def _(t):
    return P.with_category(P.classify_by_files(t.changed_files())).select(
        "change_id", "category_id", "category_name", "confidence", "promotion_path", "sla_hours",
        "rollback_runbook")


def _open_approvals() -> str:
    cases = []
    for category, needed in P.APPROVERS.items():
        terms = [f"greatest({least} - coalesce({role}, 0), 0)" for role, least in needed.items()]
        cases.append(f"WHEN {category} THEN {' + '.join(terms) or '0'}")
    return f"CAST(CASE category_id {' '.join(cases)} END AS BIGINT)"


@query("g10_promotion_readiness", f"""
SELECT *, hold_done AND canary_done AND wait_done AND teams_done AND approvals_missing = 0 AS ready FROM (
  SELECT change_id, category_id,
    checked_at >= staged_at + staging_hold_hours * INTERVAL 1 HOUR AS hold_done,
    canary_hold_hours = 0 OR coalesce(checked_at >= canary_at + canary_hold_hours * INTERVAL 1 HOUR, false) AS canary_done,
    checked_at >= staged_at + mandatory_wait_days * INTERVAL 1 DAY AS wait_done,
    category_id <> 3 OR coalesce(two_teams, false) AS teams_done,
    {_open_approvals()} AS approvals_missing,
    checked_at > opened_at + to_microseconds(CAST(sla_hours * 3600000000 AS BIGINT))
      AS sla_breached,
    coalesce(checked_at > staged_at + retroactive_review_hours * INTERVAL 1 HOUR, false)
      AND NOT coalesce(reviewed_at <= checked_at, false) AS review_overdue
  FROM v_by_rules JOIN v_categories USING (category_id) JOIN v_changes USING (change_id)
  LEFT JOIN (SELECT change_id,
    count(DISTINCT approver) FILTER (role = 'engineer') AS engineer,
    count(DISTINCT approver) FILTER (role = 'senior_engineer') AS senior_engineer,
    count(DISTINCT approver) FILTER (role = 'data_platform_lead') AS data_platform_lead,
    count(DISTINCT approver) FILTER (role = 'senior_engineer_oncall') AS senior_engineer_oncall
    FROM v_approvals GROUP BY change_id) USING (change_id)
  LEFT JOIN (SELECT DISTINCT change_id, true AS two_teams FROM v_approvals a JOIN v_approvals b USING (change_id)
    WHERE a.role = 'engineer' AND b.role = 'engineer' AND a.approver <> b.approver
      AND a.team = 'data_engineering' AND b.team <> 'data_engineering') USING (change_id))""")
def _(t):
    changes = t.changes()
    classified = P.classify_by_rules(t.changed_files(), changes)
    return P.readiness(classified, changes, t.approvals())


# --- Rollback, canary, staging ----------------------------------------------------------
VIEWS["v_deployments"] = f"""
SELECT tenant_id, CAST(1 + CAST(substr(tenant_id, 6) AS INT) % 5 AS INT) AS category_id,
  TIMESTAMP '{FIRST_RUN}' AS deployed_at FROM (SELECT DISTINCT tenant_id FROM v_fine_typed)"""


def deployments(t: Tables) -> DataFrame:
    """One deployment per tenant, its category chosen by the tenant's number."""
    tenants = t.raw("events").select(
        (F.col("user_id") % 50).alias("unit")).distinct()
    return t.stored("deployments", lambda: tenants.select(
        F.concat(F.lit("unit-"), F.col("unit")).alias("tenant_id"),
        (F.col("unit") % 5 + 1).cast("int").alias("category_id"),
        ts(FIRST_RUN).alias("deployed_at")))


def _metrics_sql(hours: str) -> str:
    after = f"_ingested_at >= deployed_at AND _ingested_at < deployed_at + ({hours}) * INTERVAL 1 HOUR"
    before = f"_ingested_at < deployed_at AND _ingested_at >= deployed_at - ({hours}) * INTERVAL 1 HOUR"
    good = sql_in(S.CONTRACT_STATUSES)
    return f"""
SELECT tenant_id, category_id, b AS rows_before, a AS rows_after,
  {sql_pct('m', 'a', 2)} AS null_rate_pct, {sql_pct('u', 'a', 2)} AS unexpected_pct,
  round((a::DOUBLE - b) * 100 / NULLIF(b, 0), 2) AS row_count_delta_pct
FROM (SELECT tenant_id, category_id, count(*) FILTER ({before}) AS b, count(*) FILTER ({after}) AS a,
    count(*) FILTER ({after} AND status IS NULL) AS m,
    count(*) FILTER ({after} AND coalesce(status NOT IN {good}, true)) AS u
  FROM v_fine_typed JOIN v_deployments USING (tenant_id) JOIN v_categories USING (category_id)
  GROUP BY ALL)"""


def windowed(t: Tables) -> DataFrame:
    rules = P.categories(t.spark).select("category_id", "rollback_window_hours", "drift_blocks")
    return deployments(t).join(F.broadcast(rules), "category_id")


def metrics(t: Tables, hours) -> DataFrame:
    rows = SV.silver_projection(t.bronze("fine"))
    known = F.coalesce(F.col("status").isin(S.CONTRACT_STATUSES), F.lit(False))
    return P.window_metrics(
        rows, windowed(t).drop("drift_blocks"), hours, F.col("status").isNull(), ~known)


#: The tenant that sends a field of its own from its deployment on.
DRIFTING = "unit-7"


@query("g11_rollback_recommendation", f"""
WITH near AS (SELECT tenant_id, _ingested_at >= deployed_at AS after,
    unnest(list_concat(json_keys(payload), CASE WHEN tenant_id = '{DRIFTING}' AND _ingested_at >= deployed_at THEN ['risk_code'] ELSE [] END)) AS field
  FROM v_fine_bronze JOIN v_deployments USING (tenant_id) JOIN v_categories USING (category_id)
  WHERE drift_blocks AND _ingested_at >= deployed_at - rollback_window_hours * INTERVAL 1 HOUR
    AND _ingested_at < deployed_at + rollback_window_hours * INTERVAL 1 HOUR),
drift AS (SELECT tenant_id, list(DISTINCT field ORDER BY field) FILTER (after) IS DISTINCT FROM list(DISTINCT field ORDER BY field) FILTER (NOT after) AS drifts
  FROM near GROUP BY tenant_id HAVING bool_or(after) AND bool_or(NOT after))
SELECT tenant_id, category_id, unexpected_pct, row_count_delta_pct,
  concat_ws(',', CASE WHEN unexpected_pct > dq_failure_limit_pct THEN 'dq_failure_rate' END,
    CASE WHEN abs(row_count_delta_pct) > row_delta_limit_pct THEN 'row_count_delta' END,
    CASE WHEN drift_blocks AND coalesce(drifts, false) THEN 'schema_drift' END) AS reasons,
  rollback_runbook, reasons <> '' AS recommend_rollback
FROM ({_metrics_sql('rollback_window_hours')}) JOIN v_categories USING (category_id) LEFT JOIN drift USING (tenant_id)""")
def _(t):
    hours = F.col("rollback_window_hours")
    own = (F.col("tenant_id") == DRIFTING) & (F.col("_ingested_at") >= ts(FIRST_RUN))
    payload = F.when(own, F.regexp_replace("payload", "[}]$", ',"risk_code":"R1"}')).otherwise(F.col("payload"))
    sent = t.bronze("fine").withColumn("payload", payload)
    drift = P.schema_drift(sent, windowed(t).filter("drift_blocks"), hours)
    return P.rollback_recommendations(
        metrics(t, hours).join(drift, "tenant_id", "left"),
        drift=F.coalesce("schema_drift", F.lit(False)))


@query("g13_canary_verdict", f"""
SELECT tenant_id, null_rate_pct, row_count_delta_pct, unexpected_pct,
  concat_ws(',', CASE WHEN null_rate_pct > 2 THEN 'null_rate_pct' END,
    CASE WHEN abs(row_count_delta_pct) > 10 THEN 'row_count_delta_pct' END,
    CASE WHEN unexpected_pct > 5 THEN 'unexpected_pct' END) AS reasons,
  CASE WHEN reasons = '' THEN 'PASS' ELSE 'FAIL' END AS verdict
FROM ({_metrics_sql('24')})""")
def _(t):
    return P.canary_verdict(metrics(t, F.lit(P.CANARY_HOLD_HOURS)))


def customer_payloads(t: Tables) -> DataFrame:
    """One event per customer; those of one market segment send a field of their own."""
    return t.raw("customer").select(
        F.concat(F.lit("cust-"), F.col("c_custkey")).alias("tenant_id"),
        F.to_json(F.struct(
            F.lit("pending").alias("status"),
            F.concat(F.lit("REF-"), F.col("c_custkey")).alias("reference_id"),
            F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("M-1")).alias("machine_id"),
        )).alias("payload"))


@query("g12_canary_candidates", """
WITH volumes AS (SELECT 'cust-' || o_custkey AS tenant_id, count(*) AS volume FROM orders
  GROUP BY ALL), middle AS (SELECT quantile_cont(volume, 0.5) AS median FROM volumes)
SELECT v.tenant_id, volume, median FROM v_registry r JOIN volumes v USING (tenant_id)
CROSS JOIN middle
WHERE state = 'ACTIVE' AND abs(volume - median) * 100 <= median * 20 AND r.tenant_id NOT IN
  (SELECT 'cust-' || c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""")
def _(t):
    volumes = t.change_log().groupBy("tenant_id").agg(F.count(F.lit(1)).alias("volume"))
    typical = t.stored("typical", lambda: P.typical_tenants(t.registry(), volumes), ())
    bronze = customer_payloads(t).join(typical, "tenant_id", "left_semi")
    flags = V.deviation_flags(bronze, V.deviations(V.source_fields(bronze)))
    return P.canary_candidates(typical, flags.filter("has_deviation"))


_VALID = f"status IN {sql_in(S.MODEL_STATUSES)}"


@query("g14_staging_comparison", f"""
WITH joined AS (SELECT coalesce(b.tenant_id, s.tenant_id) AS tenant_id, b.event_id AS b,
    s.event_id AS s, b.status IS DISTINCT FROM s.status AS differs
  FROM v_silver_1 b FULL JOIN v_silver_2 s USING (tenant_id, event_id)),
rated AS (SELECT tenant_id, {sql_pct(
    f"((CASE WHEN count(*) FILTER (status IS NULL) = 0 THEN 1 ELSE 0 END) + "
    f"(CASE WHEN count(*) FILTER (NOT {_VALID}) = 0 THEN 1 ELSE 0 END))", "2", 2)}
    AS pass_rate_pct FROM v_silver_2 GROUP BY tenant_id),
counted AS (SELECT tenant_id, count(b) AS baseline_rows, count(s) AS staging_rows,
    count(*) FILTER (b IS NULL) AS added, count(*) FILTER (s IS NULL) AS removed,
    count(*) FILTER (b IS NOT NULL AND s IS NOT NULL AND differs) AS changed
  FROM joined GROUP BY tenant_id)
SELECT *, round((staging_rows - baseline_rows) * 100::DOUBLE / NULLIF(baseline_rows, 0), 2)
    AS row_count_delta_pct, false AS schema_drift,
  concat_ws(',', CASE WHEN coalesce(abs(row_count_delta_pct) > 10, true) THEN 'row_count_delta' END,
    CASE WHEN coalesce(pass_rate_pct < 100, true) THEN 'dq_pass_rate' END)
    AS issues, CASE WHEN issues <> '' THEN 'BLOCK' ELSE 'PROMOTE' END AS recommendation
FROM counted JOIN rated USING (tenant_id)""")
def _(t):
    columns = ["tenant_id", "event_id", "status"]
    staging = silver_now(t).select(*columns)
    rules = [Q.not_null("status", "sev1"), Q.in_set("status", S.MODEL_STATUSES, "sev1")]
    rated = Q.pass_rates(Q.evaluate(staging, rules, "silver"), "tenant_id").select(
        "tenant_id", "pass_rate_pct")
    return P.staging_comparison(
        staging, silver_1(t).select(*columns), ("tenant_id", "event_id"), rated)


@query("g14_schema_differences", """
WITH staging AS (SELECT column_name, column_type FROM (DESCRIBE SELECT * EXCLUDE (source_system), CAST(event_timestamp AS VARCHAR) AS loaded FROM v_silver_2)),
baseline AS (SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM v_silver_1))
SELECT column_name, lower(replace(s.column_type, 'VARCHAR', 'STRING')) AS staging_type, lower(replace(b.column_type, 'VARCHAR', 'STRING')) AS baseline_type
FROM staging s FULL JOIN baseline b USING (column_name) WHERE s.column_type IS DISTINCT FROM b.column_type""")
def _(t):
    """A staged Silver that lost a column and got one, against the table in use."""
    staging = silver_now(t).drop("source_system").withColumn("loaded", F.col("event_timestamp").cast("string"))
    return P.schema_differences(staging, silver_1(t))


@query("g14_drift_blocks", """
SELECT tenant_id, count(*) AS staging_rows, true AS schema_drift, 'BLOCK' AS recommendation FROM v_silver_2 GROUP BY tenant_id""")
def _(t):
    """A staged table whose columns differ is blocked for every tenant, whatever its rows."""
    staging, baseline = silver_now(t), silver_1(t)
    keys = ("tenant_id", "event_id")
    rated = staging.select("tenant_id").distinct().withColumn("pass_rate_pct", F.lit(100.0))
    return P.staging_comparison(staging.drop("source_system"), baseline, keys, rated).select(
        "tenant_id", "staging_rows", "schema_drift", "recommendation")


# --- Changelog --------------------------------------------------------------------------
DAYS = 90
VIEWS["v_recent"] = f"""
SELECT * FROM v_log SEMI JOIN (SELECT tenant_id FROM v_registry WHERE state = 'ACTIVE') a
USING (tenant_id) WHERE change_timestamp >= DATE '{ORDERS_AS_OF}' - {DAYS}
QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY change_timestamp DESC, description) <= 200"""
VIEWS["v_facts"] = """
SELECT tenant_id, count(*) AS changes, string_agg(DISTINCT change_type, ',' ORDER BY change_type)
    AS kinds,
  count(*) FILTER (change_type = 'DASHBOARDS_SCAFFOLDED') AS dashboards,
  count(*) FILTER (change_type = 'QUALITY_SCAFFOLDED') AS quality_rules,
  count(*) FILTER (change_type = 'PIPELINES_SCAFFOLDED') AS pipelines
FROM v_recent GROUP BY tenant_id"""


def _plural(column: str, word: str) -> str:
    return f"CASE WHEN {column} = 1 THEN '1 {word} update was made.' WHEN {column} > 1 " \
           f"THEN {column} || ' {word} updates were made.' END"


VIEWS["v_summaries"] = f"""
SELECT tenant_id, concat_ws(' ', CASE WHEN changes = 1 THEN
    'In the past {DAYS} days, 1 change was made to your data platform.' ELSE
    'In the past {DAYS} days, ' || changes || ' changes were made to your data platform.' END,
  {_plural('dashboards', 'dashboard')}, {_plural('quality_rules', 'quality monitoring')},
  {_plural('pipelines', 'processing')},
  'Please contact your platform team if you have any questions.') AS summary
FROM v_facts"""


def recent(t: Tables) -> DataFrame:
    return C.recent_changes(t.change_log(), t.registry(), ORDERS_AS_OF, DAYS)


@query("c01_recent_changes", """
SELECT tenant_id, change_timestamp, change_type, component, description FROM v_recent""")
def _(t):
    return recent(t).select(
        "tenant_id", "change_timestamp", "change_type", "component", "description")


@query("w07_latest_changes_per_tenant", """
SELECT tenant_id, change_timestamp, description, row_number() OVER (PARTITION BY tenant_id
  ORDER BY change_timestamp DESC, description)::INT AS rank FROM v_log QUALIFY rank <= 3""")
def _(t):
    return C.latest_changes(t.change_log(), 3).select(
        "tenant_id", "change_timestamp", "description", "rank")


@query("p21_change_texts", """
SELECT tenant_id, string_agg('- ' || strftime(change_timestamp, '%Y-%m-%d %H:%M:%S') || ': [' ||
  coalesce(component, 'unknown component') || '] ' || description, chr(10)
  ORDER BY change_timestamp DESC, description) AS changes FROM v_recent GROUP BY tenant_id""")
def _(t):
    return C.change_texts(recent(t))


@query("c02_summary_facts", "SELECT * FROM v_facts")
def _(t):
    return C.summary_facts(recent(t))


@query("c02_s11_summary_sink", f"""
SELECT tenant_id, summary, {DAYS} AS lookback_days, TIMESTAMP '{ORDERS_AS_OF}' AS generated_at,
  'rules' AS model FROM v_summaries""")
def _(t):
    texts = C.summaries(C.summary_facts(recent(t)), DAYS)
    path = new_path(t.spark, "changelog_summaries")
    for _ in range(2):  # a run that is repeated adds nothing
        append_once(C.summary_rows(texts, DAYS, ts(ORDERS_AS_OF)), path, f"summaries-{ORDERS_AS_OF}", ())
    return read_table(t.spark, path, S.CHANGELOG_SUMMARIES)


@query("c03_summary_leaks", """
SELECT tenant_id, lower(tenant_id) AS word, 'tenant' AS kind FROM v_log
  WHERE component = '1-URGENT' GROUP BY ALL
UNION ALL
SELECT DISTINCT tenant_id, word, 'technical' FROM (
  SELECT tenant_id, unnest(['gold', 'silver.events']) AS word FROM v_log
  WHERE component = '5-LOW')""")
def _(t):
    # Careless texts: urgent changes name the tenant, minor ones name internals.
    careless = (
        F.when(F.col("component") == "1-URGENT",
               F.concat(F.lit("Change for "), F.col("tenant_id"), F.lit(" was made.")))
        .when(F.col("component") == "5-LOW", "The Gold refresh of silver.events was changed.")
        .otherwise("A dashboard was updated."))
    return C.leaks(t.change_log().withColumn("summary", careless), t.registry())
