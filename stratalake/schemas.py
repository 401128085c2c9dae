"""Column layout of every table, plus the fixed value sets of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _TS, _D, _B, _L, _F, _I = (
    T.StringType(), T.TimestampType(), T.DateType(), T.BooleanType(),
    T.LongType(), T.DoubleType(), T.IntegerType(),
)

# --- Fixed values: the layouts of the platform's tables ------------------------------

BRONZE_EVENTS = _struct(
    ("tenant_id", _S, False), ("event_id", _S, False), ("event_type", _S, False),
    ("event_timestamp", _TS, False), ("source_system", _S, True), ("payload", _S, True),
    ("_ingested_at", _TS, True), ("_source_file", _S, True), ("_batch_id", _S, True),
)

# Bronze on disk: one folder per tenant and week of arrival, so that a bound on the arrival reaches the files,
# and in it one per load, so that a load written again replaces itself.
BRONZE_STORED = T.StructType([*BRONZE_EVENTS.fields, T.StructField("ingest_week", _D), T.StructField("load_id", _S)])
BRONZE_PARTITIONS = ("tenant_id", "ingest_week")

# What a source drops into the landing folder: Bronze without the audit columns.
LANDING_EVENTS = T.StructType(BRONZE_EVENTS.fields[:6])

# Landed lines that are no events or could not be read in full.
LANDING_REJECTS = _struct(
    ("tenant_id", _S, False), ("raw", _S, False), ("_ingested_at", _TS, True),
    ("_source_file", _S, True), ("_batch_id", _S, True),
)

SILVER_EVENTS = _struct(
    ("tenant_id", _S, False), ("event_id", _S, False), ("event_type", _S, False),
    ("event_timestamp", _TS, False), ("source_system", _S, True), ("status", _S, True),
    ("reference_id", _S, True), ("created_at", _TS, True), ("last_updated_at", _TS, True),
    ("_batch_id", _S, True),
)

# Silver on disk: the rows above with what a merge in any order needs, one folder per tenant and bucket.
SILVER_STATE = T.StructType([
    *SILVER_EVENTS.fields, *_struct(
        ("_first_at", _TS, True), ("_first_status", _S, True), ("_status_at", _TS, True),
        ("_status_batch", _S, True), ("_latest_status", _S, True), ("bucket", _I, True)).fields])
SILVER_PARTITIONS = ("tenant_id", "bucket")

VAULT_HUB = _struct(
    ("h_event_hk", _S, False), ("tenant_id", _S, False), ("event_id", _S, False),
    ("load_dts", _TS, False), ("record_source", _S, False),
)

VAULT_SATELLITE = _struct(
    ("h_event_hk", _S, False), ("load_dts", _TS, False), ("load_end_dts", _TS, True),
    ("tenant_id", _S, False), ("hash_diff", _S, False), ("status", _S, True),
    ("reference_id", _S, True), ("event_type", _S, True), ("record_source", _S, False),
)

TENANT_REGISTRY = _struct(
    ("tenant_id", _S, False), ("display_name", _S, True), ("env", _S, False),
    ("state", _S, False), ("created_at", _TS, True), ("activated_at", _TS, True),
    ("deactivated_at", _TS, True), ("deactivation_reason", _S, True),
)

TENANT_CHANGE_LOG = _struct(
    ("tenant_id", _S, False), ("change_timestamp", _TS, True), ("change_type", _S, False),
    ("component", _S, True), ("description", _S, True), ("changed_by", _S, True),
    ("pr_url", _S, True), ("env", _S, False),
)

DQ_CONTRACTS = _struct(
    ("tenant_id", _S, False), ("layer", _S, False), ("contract_path", _S, True),
    ("created_at", _TS, True), ("is_active", _B, True),
)

DQ_RESULTS = _struct(
    ("tenant_id", _S, False), ("run_date", _D, False), ("layer", _S, False),
    ("expectation_type", _S, True), ("column_name", _S, True), ("success", _B, True),
    ("observed_value", _F, True), ("expected_value", _F, True),
    ("unexpected_count", _L, True), ("unexpected_pct", _F, True),
)

SILVER_WATERMARKS = _struct(
    ("tenant_id", _S, False), ("table_name", _S, False), ("last_updated_at", _TS, True),
)

TENANT_DASHBOARDS = _struct(
    ("tenant_id", _S, False), ("template_name", _S, False), ("dashboard_id", _S, False),
    ("env", _S, False), ("registered_at", _TS, True), ("dashboard_type", _S, True),
)

DQ_ALERTS = _struct(
    ("tenant_id", _S, False), ("layer", _S, True), ("metric", _S, True), ("severity", _S, True),
    ("current_value", _F, True), ("baseline_value", _F, True), ("delta_pct", _F, True),
    ("description", _S, True), ("detected_at", _TS, True), ("resolved", _B, True),
)

CHANGELOG_SUMMARIES = _struct(
    ("tenant_id", _S, False), ("summary", _S, True), ("lookback_days", _I, True),
    ("generated_at", _TS, True), ("model", _S, True),
)

# The library's own records of what was written.
LOADS = _struct(("load_id", _S, True), ("loaded_at", _TS, True))
# What the event-time stream writes: KPI rows of closed days, and versions that count towards none.
DAILY_KPI = _struct(
    ("tenant_id", _S, True), ("event_date", _D, True), ("event_type", _S, True), ("status", _S, True),
    ("event_count", _L, True), ("unique_references", _L, True), ("first_event_ts", _TS, True), ("last_event_ts", _TS, True),
)
SET_ASIDE_EVENTS = T.StructType([*BRONZE_EVENTS.fields, T.StructField("reason", _S)])
RELEASES = _struct(("release", _S, True), ("number", _L, True), ("released_at", _TS, True))

# --- Fixed values of the data model -------------------------------------------------
PAYLOAD_FIELDS = [
    "status", "reference_id", "workflow_id", "approval_tier", "vendor_code", "amount_usd",
]
EVENT_STATUSES = [
    "pending", "in_progress", "pending_audit", "escalated", "approved", "rejected", "completed",
]
CONTRACT_STATUSES = ["pending", "in_progress", "completed", "approved", "rejected", "cancelled"]
MODEL_STATUSES = [
    "pending", "in_progress", "completed", "approved", "rejected", "cancelled",
    "pending_audit", "escalated",
]
OUTCOMES = ["approved", "rejected", "escalated", "in_progress"]
TERMINAL_STATUSES = ["completed", "approved", "rejected"]
ESCALATED_STATUSES = ["pending_audit", "escalated"]
SOURCE_SYSTEMS = ["erp-sap", "portal-web", "api-mobile", "batch-file"]
APPROVAL_TIERS = ["standard", "expedited", "executive"]
DASHBOARD_TEMPLATES = [
    "kpi_overview", "approval_volume", "cycle_time", "vendor_analytics", "user_activity",
]
CONTRACT_LAYERS = ["bronze", "silver", "gold"]
STATES = [
    "PENDING", "REGISTERED", "GRANTS_PROVISIONED", "PIPELINES_SCAFFOLDED",
    "DASHBOARDS_SCAFFOLDED", "QUALITY_SCAFFOLDED", "ACTIVE",
]
FAILED = "FAILED"
STANDARD_FIELDS = [f.name for f in SILVER_EVENTS.fields]
PLATFORM_FIELDS = ["tenant_id", "created_at", "last_updated_at", "_batch_id"]
EXPECTED_TYPES = {
    "tenant_id": "STRING", "event_id": "STRING", "event_type": "STRING",
    "event_timestamp": "TIMESTAMP", "status": "STRING", "reference_id": "STRING",
}
# ------------------------------------------------------------------------------------
