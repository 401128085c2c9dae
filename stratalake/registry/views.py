"""SQL text of the derived platform tables, used by the equivalent SQL of each query."""

from __future__ import annotations

from stratalake.sources.tables import (
    AS_OF, CHANGE_TYPES, EVENT_TYPES, FILE_PATHS, FIRST_RUN, SECOND_RUN, STATE_OF_PRIORITY,
)
from stratalake import schemas as S


def sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def sql_case(column: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


VIEWS: dict[str, str] = {}

VIEWS["v_ev"] = f"""
SELECT event_id AS n, user_id, ts AS event_timestamp, value,
  'E' || event_id AS event_id,
  {sql_case('event_type', EVENT_TYPES)} AS event_type,
  {sql_list(S.SOURCE_SYSTEMS)}[CAST(event_id % 4 AS INT) + 1] AS source_system,
  'R' || user_id || '-' || (event_id % 6) AS ref,
  {sql_list(S.APPROVAL_TIERS)}[CAST(event_id % 3 AS INT) + 1] AS approval_tier,
  'VND-' || (event_id % 40) AS vendor_code,
  {sql_list(S.EVENT_STATUSES)}[CAST((event_id * 3 + user_id) % 7 AS INT) + 1] AS status0,
  {sql_list([*S.EVENT_STATUSES, None])}[CAST((event_id * 5 + user_id) % 8 AS INT) + 1] AS status1
FROM events"""


def _bronze(tenant: str, status: str, hours: str, batch: str) -> str:
    return f"""
SELECT {tenant} AS tenant_id, event_id, event_type, event_timestamp, source_system,
  json_object('workflow_id', 'WF-' || ref, 'approval_tier', approval_tier,
    'vendor_code', vendor_code, 'amount_usd', value, 'status', {status},
    'reference_id', CASE WHEN event_type <> 'notification' THEN ref END) AS payload,
  event_timestamp + ({hours}) * INTERVAL 1 HOUR AS _ingested_at,
  'landing/' || CAST(CAST(event_timestamp AS DATE) AS VARCHAR) || '.json' AS _source_file,
  '{batch}' || (n // 1000) AS _batch_id
FROM v_ev"""


_SHARED, _FINE = "'tenant-' || (user_id % 5)", "'unit-' || (user_id % 50)"
VIEWS["v_bronze_first"] = _bronze(_SHARED, "status0", "n % 72", "batch-")
VIEWS["v_bronze_fixes"] = _bronze(_SHARED, "status1", "n % 48 + 96", "fix-")
VIEWS["v_bronze"] = "SELECT * FROM v_bronze_first UNION ALL SELECT * FROM v_bronze_fixes"
VIEWS["v_fine_first"] = _bronze(_FINE, "status0", "n % 72", "batch-")
VIEWS["v_fine_fixes"] = _bronze(_FINE, "status1", "n % 48 + 96", "fix-")
VIEWS["v_fine_bronze"] = "SELECT * FROM v_fine_first UNION ALL SELECT * FROM v_fine_fixes"


def _typed(source: str, reference: str) -> str:
    return f"""
SELECT tenant_id, event_id, event_type, event_timestamp, source_system,
  payload ->> '$.status' AS status, {reference} AS reference_id,
  payload ->> '$.workflow_id' AS workflow_id, payload ->> '$.approval_tier' AS approval_tier,
  payload ->> '$.vendor_code' AS vendor_code, payload ->> '$.amount_usd' AS amount_usd,
  _ingested_at, _batch_id
FROM {source}"""


_REF = "payload ->> '$.reference_id'"
_REF_OR_WORKFLOW = "coalesce(payload ->> '$.reference_id', payload ->> '$.workflow_id')"
VIEWS["v_silver"] = _typed("v_bronze_first", _REF)
VIEWS["v_typed"] = _typed("v_bronze", _REF_OR_WORKFLOW)
VIEWS["v_fine_typed"] = _typed("v_fine_bronze", _REF)

# Silver after the first and after the second load: every version merged in order of arrival.
def _silver(arrived: str) -> str:
    return f"""
SELECT f.tenant_id, f.event_id, f.event_type, f.event_timestamp, f.source_system,
  CASE WHEN f.status IS NOT NULL THEN l.status END AS status, f.reference_id, f._batch_id
FROM (SELECT * FROM v_typed WHERE {arrived} QUALIFY row_number() OVER (
    PARTITION BY tenant_id, event_id ORDER BY _ingested_at, _batch_id, status NULLS FIRST) = 1) f
LEFT JOIN (SELECT * FROM v_typed WHERE {arrived} AND status IS NOT NULL QUALIFY row_number() OVER (
    PARTITION BY tenant_id, event_id ORDER BY _ingested_at DESC, _batch_id DESC, status DESC) = 1) l
  USING (tenant_id, event_id)"""


VIEWS["v_silver_1"] = f"""
SELECT tenant_id, event_id, event_type, event_timestamp, source_system, status, reference_id,
  TIMESTAMP '{FIRST_RUN}' AS created_at, TIMESTAMP '{FIRST_RUN}' AS last_updated_at, _batch_id
FROM ({_silver(f"_ingested_at <= TIMESTAMP '{FIRST_RUN}'")})"""
VIEWS["v_silver_2"] = f"""
SELECT n.tenant_id, n.event_id, n.event_type, n.event_timestamp, n.source_system, n.status,
  n.reference_id, coalesce(o.created_at, TIMESTAMP '{SECOND_RUN}') AS created_at,
  CASE WHEN o.event_id IS NOT NULL AND o.status IS NOT DISTINCT FROM n.status
    THEN o.last_updated_at ELSE TIMESTAMP '{SECOND_RUN}' END AS last_updated_at, n._batch_id
FROM ({_silver("true")}) n LEFT JOIN v_silver_1 o USING (tenant_id, event_id)"""

# --- Gold ---------------------------------------------------------------------------
VIEWS["v_kpi"] = f"""
SELECT tenant_id, CAST(event_timestamp AS DATE) AS event_date, event_type, status,
  count(*) AS event_count, count(DISTINCT reference_id) AS unique_references,
  min(event_timestamp) AS first_event_ts, max(event_timestamp) AS last_event_ts
FROM v_silver WHERE event_timestamp >= DATE '{AS_OF}' - 90 GROUP BY ALL"""
VIEWS["v_lifecycle"] = """
SELECT tenant_id, reference_id, min(event_timestamp) AS started_at,
  max(event_timestamp) FILTER (status IN ('completed', 'approved', 'rejected')) AS completed_at,
  count(DISTINCT event_type) AS step_count, count(*) AS total_events,
  max(CASE WHEN status = 'approved' THEN 1 ELSE 0 END) AS was_approved,
  max(CASE WHEN status = 'rejected' THEN 1 ELSE 0 END) AS was_rejected,
  max(CASE WHEN status IN ('pending_audit', 'escalated') THEN 1 ELSE 0 END) AS was_escalated
FROM v_silver WHERE reference_id IS NOT NULL GROUP BY ALL"""
VIEWS["v_cycle"] = """
SELECT *, CAST(date_diff('day', CAST(started_at AS DATE), CAST(completed_at AS DATE)) AS INT)
    AS cycle_days,
  CAST(date_diff('day', CAST(started_at AS DATE), CAST(completed_at AS DATE)) AS DOUBLE) * 24
    AS cycle_hours,
  CASE WHEN was_approved = 1 THEN 'approved' WHEN was_rejected = 1 THEN 'rejected'
    WHEN was_escalated = 1 THEN 'escalated' ELSE 'in_progress' END AS final_status
FROM v_lifecycle WHERE completed_at IS NOT NULL"""
VIEWS["v_weekly"] = f"""
SELECT tenant_id, CAST(date_trunc('week', event_timestamp) AS DATE) AS week_start, status,
  count(DISTINCT reference_id) AS refs
FROM v_silver WHERE event_timestamp >= DATE '{AS_OF}' - 90 GROUP BY ALL"""
VIEWS["v_funnel"] = """
SELECT tenant_id, week_start,
  CAST(coalesce(sum(refs) FILTER (status = 'pending'), 0) AS BIGINT) AS submitted,
  CAST(coalesce(sum(refs) FILTER (status = 'in_progress'), 0) AS BIGINT) AS in_review,
  CAST(coalesce(sum(refs) FILTER (status = 'pending_audit'), 0) AS BIGINT) AS pending_audit,
  CAST(coalesce(sum(refs) FILTER (status = 'escalated'), 0) AS BIGINT) AS escalated,
  CAST(coalesce(sum(refs) FILTER (status = 'approved'), 0) AS BIGINT) AS approved,
  CAST(coalesce(sum(refs) FILTER (status = 'rejected'), 0) AS BIGINT) AS rejected,
  CAST(sum(refs) AS BIGINT) AS total
FROM v_weekly GROUP BY ALL"""

# --- Tenants, change log, changes -----------------------------------------------------
VIEWS["v_registry"] = """
SELECT 'cust-' || c_custkey AS tenant_id, c_name AS display_name, 'dev' AS env,
  CASE WHEN c_acctbal >= 2000 THEN 'ACTIVE' WHEN c_acctbal < 0 THEN 'FAILED' ELSE 'PENDING' END
    AS state,
  TIMESTAMP '1995-01-01' AS created_at,
  CASE WHEN c_acctbal >= 2000 THEN TIMESTAMP '1995-01-02' END AS activated_at,
  CAST(NULL AS TIMESTAMP) AS deactivated_at, CAST(NULL AS VARCHAR) AS deactivation_reason
FROM customer"""
VIEWS["v_log"] = f"""
SELECT 'cust-' || o_custkey AS tenant_id, o_orderdate AS change_timestamp,
  {sql_case('o_orderstatus', CHANGE_TYPES)} AS change_type,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS component,
  'change ' || o_orderkey AS description, CAST(NULL AS VARCHAR) AS changed_by,
  CAST(NULL AS VARCHAR) AS pr_url, 'dev' AS env
FROM orders"""
VIEWS["v_state_log"] = f"""
SELECT 'cust-' || o_custkey AS tenant_id,
  CASE WHEN o_orderstatus = 'F' AND o_totalprice < 50000 THEN 'FAILED'
    ELSE {sql_case('o_orderpriority', STATE_OF_PRIORITY)} END AS state,
  o_orderdate AS changed_at, o_orderkey AS seq
FROM orders"""
VIEWS["v_changes"] = """
SELECT o_orderkey AS change_id,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN '[hotfix] fix'
    ELSE 'regular change' END AS title,
  o_orderdate AS opened_at, o_orderdate + (o_custkey % 60) * INTERVAL 1 HOUR AS staged_at,
  o_orderdate + (o_orderkey % 300) * INTERVAL 1 HOUR AS checked_at,
  CASE WHEN o_custkey % 3 <> 0 THEN o_orderdate + (o_custkey % 60 + o_orderkey % 50) * INTERVAL 1 HOUR END AS canary_at,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + (o_orderkey % 200) * INTERVAL 1 HOUR END AS reviewed_at
FROM orders"""
VIEWS["v_files"] = f"""
SELECT l_orderkey AS change_id,
  {sql_list(FILE_PATHS)}[CAST((l_partkey + l_linenumber) % {len(FILE_PATHS)} AS INT) + 1] AS path
FROM lineitem"""
VIEWS["v_approvals"] = """
SELECT l_orderkey AS change_id,
  ['engineer', 'senior_engineer', 'data_platform_lead', 'senior_engineer_oncall']
    [CAST(l_suppkey % 4 AS INT) + 1] AS role, 'person-' || l_suppkey AS approver,
  ['data_engineering', 'analytics_engineering', 'platform_engineering']
    [CAST((l_suppkey + l_linenumber) % 3 AS INT) + 1] AS team
FROM lineitem"""
