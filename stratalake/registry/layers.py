"""Sources, sinks, upserts, vault loads, change feeds, streams and text expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.functions import scalars as X
from stratalake.operators import lifecycle as L
from stratalake.operators import silver as SV
from stratalake.operators import vault as V
from stratalake.operators.upsert import insert_absent
from stratalake.plans import gold as G
from stratalake.registry.base import query
from stratalake.registry.views import VIEWS, sql_list
from stratalake.session import new_path
from stratalake.sources import bronze as B
from stratalake.sources.audit import audit_rows
from stratalake.sources.inventory import column_inventory, table_inventory
from stratalake.sources.publish import (
    append_once, full_refresh, publish_view, read_table, replace_partitions,
)
from stratalake.sources.tables import AS_OF, FIRST_RUN, ORDERS_AS_OF, SECOND_RUN, Tables
from stratalake.streaming.daily import daily_kpi_stream, finished, set_aside_stream
from stratalake.streaming.ingest import bronze_stream, silver_stream


def ts(text: str):
    return F.lit(text).cast("timestamp")


def bronze_table(t: Tables):
    """Bronze as it lies on disk: by tenant and week of arrival."""
    return t.stored("bronze", lambda: B.by_arrival(t.bronze()), S.BRONZE_PARTITIONS)


def first_batch(t: Tables):
    arrived = (F.col("_ingested_at") <= ts(FIRST_RUN)) & (F.col("ingest_week") <= F.to_date(ts(FIRST_RUN)))
    return bronze_table(t).filter(arrived).drop("ingest_week")


def first_marks(t: Tables):
    return t.stored("silver_watermarks", lambda: SV.watermarks_of(first_batch(t)))


def new_rows(t: Tables):
    return SV.bronze_since(bronze_table(t), first_marks(t))


def silver_1_table(t: Tables):
    """The Silver table as the first load left it, as stored."""
    return t.stored("silver", lambda: SV.silver_from_scratch(
        SV.silver_projection(first_batch(t)), ts(FIRST_RUN)), S.SILVER_PARTITIONS)


def silver_1(t: Tables):
    return SV.published(silver_1_table(t))


def silver_2(t: Tables):
    """Silver after merging what arrived since."""
    return SV.published(SV.silver_upsert(silver_1_table(t), SV.silver_projection(new_rows(t)), ts(SECOND_RUN)))


def silver_now(t: Tables):
    """The merged Silver table, written, for checks that read it more than once."""
    return t.stored("silver_now", lambda: silver_2(t), ("tenant_id",))


VIEWS["v_marks"] = f"""
SELECT tenant_id, 'events' AS table_name, max(_ingested_at) AS last_updated_at
FROM v_bronze WHERE _ingested_at <= TIMESTAMP '{FIRST_RUN}' GROUP BY ALL"""

_BRONZE_COLUMNS = "tenant_id, event_id, event_type, event_timestamp, source_system, " \
                  "_ingested_at, _source_file, _batch_id"


# --- Sources and sinks ------------------------------------------------------------------
@query("s01_bronze_append_partitioned", f"""
SELECT {_BRONZE_COLUMNS}, payload ->> '$.status' AS status FROM v_bronze""")
def _(t):
    path = new_path(t.spark, "bronze")
    for rows, load in ((t.bronze_first(), "first"), (t.bronze_fixes(), "fixes"), (t.bronze_first(), "first")):
        B.append_bronze(rows, path, load)
    stored = read_table(t.spark, path, S.BRONZE_EVENTS)
    return stored.withColumn("status", X.json_text("payload", "status")).drop("payload")


_LANDED = """
SELECT tenant_id, event_id, event_type, event_timestamp, source_system,
  payload ->> '$.vendor_code' AS vendor_code, true AS has_file, 'batch-7' AS _batch_id
FROM v_bronze_first"""


def _landed(rows):
    return rows.select(
        "tenant_id", "event_id", "event_type", "event_timestamp", "source_system",
        X.json_text("payload", "vendor_code").alias("vendor_code"),
        (F.col("_source_file").isNotNull() & F.col("_ingested_at").isNotNull()).alias("has_file"),
        "_batch_id")


@query("s02_s03_landing_json_batch", _LANDED)
def _(t):
    landing = new_path(t.spark, "landing")
    B.write_landing(t.bronze_first(), landing)
    return _landed(B.read_landing(t.spark, landing, "batch-7"))


def landed_with_broken_lines(t: Tables) -> str:
    """A landing folder in which one event in ten is also landed as a line that breaks off."""
    landing = new_path(t.spark, "landing")
    rows = t.stored("landed", t.bronze_first)
    B.write_landing(rows, landing)
    broken = rows.filter(F.substring("event_id", 2, 20).cast("long") % 10 == 0)
    line = F.concat(F.lit('{"event_id": "'), "event_id", F.lit('", "payload": "'), F.col("event_type"))
    broken.select("tenant_id", line.alias("value")).write.mode("append").partitionBy("tenant_id").text(landing)
    return landing


_REJECTED = """
SELECT tenant_id, '{"event_id": "' || event_id || '", "payload": "' || event_type AS raw,
  true AS has_file, 'batch-7' AS _batch_id
FROM v_bronze_first WHERE CAST(substr(event_id, 2) AS BIGINT) % 10 = 0"""


def _rejected(rows):
    return rows.select("tenant_id", "raw", F.col("_source_file").isNotNull().alias("has_file"), "_batch_id")


@query("s02_rejected_lines", _REJECTED)
def _(t):
    path = new_path(t.spark, "rejects")
    rows = B.read_rejects(t.spark, landed_with_broken_lines(t), "batch-7")
    for _ in range(2):  # the second time the ledger has the load
        B.append_rejects(rows, path, "load-1")
    return _rejected(read_table(t.spark, path, S.LANDING_REJECTS))


@query("x01_rejected_lines", _REJECTED)
def _(t):
    bronze, rejects = new_path(t.spark, "bronze"), new_path(t.spark, "rejects")
    bronze_stream(t.spark, landed_with_broken_lines(t), bronze, new_path(t.spark, "stream"),
                  F.lit("batch-7"), rejects=rejects).awaitTermination()
    return _rejected(read_table(t.spark, rejects, S.LANDING_REJECTS))


@query("x01_landing_json_stream", _LANDED)
def _(t):
    landing, bronze = new_path(t.spark, "landing"), new_path(t.spark, "bronze")
    B.write_landing(t.bronze_first(), landing)
    bronze_stream(t.spark, landing, bronze, new_path(t.spark, "stream"),
                  F.lit("batch-7")).awaitTermination()
    return _landed(read_table(t.spark, bronze, S.BRONZE_EVENTS))


@query("s04_incremental_bronze_read", f"""
SELECT {", ".join("b." + c for c in _BRONZE_COLUMNS.split(", "))}
FROM v_bronze b LEFT JOIN v_marks m USING (tenant_id)
WHERE _ingested_at > coalesce(last_updated_at, TIMESTAMP '2000-01-01')""")
def _(t):
    return new_rows(t).drop("payload")


@query("s05_silver_change_feed", """
SELECT tenant_id, event_id, b.status AS status_before, a.status AS status_after,
  CASE WHEN b.event_type IS NULL THEN 'insert' ELSE 'update' END AS change
FROM v_silver_1 b FULL JOIN v_silver_2 a USING (tenant_id, event_id)
WHERE b.event_type IS NULL OR b.status IS DISTINCT FROM a.status""")
def _(t):
    feed = SV.changes_between(silver_1(t), silver_2(t), ["status", "event_type"])
    return feed.select(
        "tenant_id", "event_id", F.col("before.status").alias("status_before"),
        F.col("after.status").alias("status_after"), "change")


@query("s06_audit_append", f"""
SELECT * FROM v_log UNION ALL
SELECT tenant_id, TIMESTAMP '{ORDERS_AS_OF}', 'ACTIVATED', 'activate_tenant',
  'Tenant marked ACTIVE after all checks passed', NULL, NULL, env
FROM v_registry WHERE state = 'ACTIVE'""")
def _(t):
    path = new_path(t.spark, "change_log")
    active = t.registry().filter(F.col("state") == "ACTIVE")
    rows = audit_rows(active, ts(ORDERS_AS_OF), "ACTIVATED", "activate_tenant",
                      "Tenant marked ACTIVE after all checks passed", F.col("env"))
    # Thousands of tenants: one folder each would be many tiny files, so none here.
    for load in ("history", "activation-1", "activation-1"):  # a step that is repeated adds nothing
        append_once(t.change_log() if load == "history" else rows, path, load, ())
    return read_table(t.spark, path, S.TENANT_CHANGE_LOG)


@query("s07_gold_full_refresh", "SELECT * FROM v_kpi")
def _(t):
    path, by = new_path(t.spark, "kpi_summary"), ("tenant_id", "event_date")
    kpi = G.daily_kpi(t.silver, AS_OF, share_of_day=False)
    full_refresh(kpi, path, by)
    return read_table(t.spark, path, kpi.schema)


@query("s07_replace_touched_partitions", """
SELECT tenant_id, status, count(*) AS n, sum(CASE WHEN tenant_id = 'tenant-2' THEN 1 ELSE 0 END)
  ::BIGINT AS rewritten FROM v_silver GROUP BY ALL""")
def _(t):
    path = new_path(t.spark, "silver")
    rows = t.silver.select("tenant_id", "event_id", "status", F.lit(0).alias("rewritten"))
    full_refresh(rows, path)
    stored = read_table(t.spark, path, rows.schema)
    one = stored.filter(F.col("tenant_id") == "tenant-2")
    replace_partitions(one.withColumn("rewritten", F.lit(1)), path)
    return read_table(t.spark, path, rows.schema).groupBy("tenant_id", "status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("rewritten").alias("rewritten"))


@query("s08_event_detail_view", """
SELECT tenant_id, event_id, event_type, event_timestamp, source_system, status, reference_id,
  created_at, last_updated_at FROM v_silver_1""")
def _(t):
    return publish_view(G.event_detail(silver_1(t)), "event_detail")


def platform_tables(t: Tables):
    return {
        ("bronze", "raw_events"): t.bronze(), ("silver", "events"): silver_1(t),
        ("vault", "hub_event"): V.hub_rows(silver_1(t)),
        ("gold_tenant_1", "cycle_time"): G.cycle_time(
            t.silver.filter(F.col("tenant_id") == "tenant-1")),
        ("monitoring", "tenant_registry"): t.registry(),
        ("monitoring", "tenant_change_log"): t.change_log(),
    }


@query("s09_table_inventory", """
SELECT 'bronze' AS schema_name, 'raw_events' AS table_name, 'bronze' AS purpose,
  9 AS column_count, count(*) AS row_count FROM v_bronze
UNION ALL SELECT 'silver', 'events', 'silver', 10, count(*) FROM v_silver_1
UNION ALL SELECT 'vault', 'hub_event', 'vault', 5, count(*) FROM v_silver_1
UNION ALL SELECT 'gold_tenant_1', 'cycle_time', 'per-tenant Gold', 12, count(*) FROM v_cycle
  WHERE tenant_id = 'tenant-1'
UNION ALL SELECT 'monitoring', 'tenant_registry', 'platform monitoring', 8, count(*)
  FROM v_registry
UNION ALL SELECT 'monitoring', 'tenant_change_log', 'platform monitoring', 8, count(*)
  FROM v_log""")
def _(t):
    return table_inventory(platform_tables(t))


_COLUMNS_SQL = "\nUNION ALL\n".join(
    f"""SELECT '{schema}' AS schema_name, '{table}' AS table_name, CAST(row_number() OVER () AS INT) AS ordinal, column_name,
  replace(column_type, 'VARCHAR', 'STRING') AS data_type FROM (DESCRIBE SELECT * FROM {view})"""
    for schema, table, view in (("silver", "events", "v_silver_1"), ("monitoring", "tenant_registry", "v_registry"),
                                ("monitoring", "tenant_change_log", "v_log")))


@query("s09_column_inventory", _COLUMNS_SQL)
def _(t):
    tables = {k: v for k, v in platform_tables(t).items() if k[0] == "monitoring" or k == ("silver", "events")}
    return column_inventory(t.spark, tables).drop("is_nullable")


# --- Upserts ----------------------------------------------------------------------------
@query("m01_silver_upsert", "SELECT * FROM v_silver_2")
def _(t):
    return silver_2(t)


@query("m01_silver_upsert_checked_size", "SELECT * FROM v_silver_2")
def _(t):
    state = t.stored("batch_state", lambda: SV.event_state(SV.silver_projection(new_rows(t))))
    return SV.published(SV.silver_upsert(silver_1_table(t), state, ts(SECOND_RUN), stored_state=True))


@query("m01_any_split_into_batches", """
SELECT tenant_id, event_id, event_type, event_timestamp, source_system, status, reference_id,
  _batch_id, splits FROM v_silver_2, (SELECT unnest(['1', '2', '5 from the last']) AS splits)""")
def _(t):
    """Silver from one batch, two, and five that come in reverse order."""
    versions = t.stored("versions", lambda: SV.silver_projection(bronze_table(t)), ())
    out = None
    for name, order in {"1": [0], "2": [0, 1], "5 from the last": [4, 3, 2, 1, 0]}.items():
        n, path = int(name.split()[0]), new_path(t.spark, "silver")
        for part in order:
            batch = versions.filter(F.pmod(F.xxhash64("_ingested_at", "event_id"), F.lit(n)) == part)
            SV.merge_into(t.spark, path, batch, ts(SECOND_RUN))
        rows = SV.published(read_table(t.spark, path, S.SILVER_STATE)).drop("created_at", "last_updated_at")
        rows = rows.withColumn("splits", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("m02_x03_watermark_upsert", """
SELECT tenant_id, 'events' AS table_name, max(_ingested_at) AS last_updated_at
FROM v_bronze GROUP BY ALL""")
def _(t):
    return SV.watermark_upsert(first_marks(t), SV.watermarks_of(new_rows(t)))


_HUB = """
SELECT sha256(upper(trim(event_id))) AS h_event_hk, tenant_id, min(event_id) AS event_id,
  min(event_timestamp) AS load_dts, 'silver.events' AS record_source
FROM {source} GROUP BY 1, 2"""


@query("m03_hub_initial_load", _HUB.format(source="v_silver"))
def _(t):
    return V.hub_rows(t.silver)


@query("m03_hub_incremental_load", f"""
WITH known AS ({_HUB.format(source="v_silver_1")}), now AS ({_HUB.format(source="v_silver_2")})
SELECT now.* FROM now ANTI JOIN known USING (h_event_hk, tenant_id)""")
def _(t):
    return V.hub_load(V.hub_rows(silver_1(t)), silver_2(t))


_FINGERPRINT = "sha256(" + " || ".join(
    f"coalesce(length({c}) || ':' || {c}, '<null>')" for c in V.SATELLITE_ATTRIBUTES) + ")"

_SATELLITE = f"""
WITH hashed AS (SELECT *, {_FINGERPRINT} AS hash_diff FROM v_typed),
starts AS (SELECT * FROM hashed QUALIFY hash_diff IS DISTINCT FROM lag(hash_diff) OVER (
  PARTITION BY tenant_id, event_id ORDER BY _ingested_at, _batch_id, hash_diff))
SELECT sha256(upper(trim(event_id))) AS h_event_hk, _ingested_at AS load_dts,
  lead(_ingested_at) OVER (PARTITION BY tenant_id, event_id
    ORDER BY _ingested_at, _batch_id, hash_diff) AS load_end_dts,
  tenant_id, hash_diff, status, reference_id, event_type, 'silver.events' AS record_source
FROM starts"""


def versions(rows):
    return V.satellite_versions(SV.silver_projection(rows))


@query("m04_satellite_history", _SATELLITE)
def _(t):
    return V.satellite_history(versions(t.bronze()))


@query("m04_satellite_next_batch", _SATELLITE)
def _(t):
    before = t.stored("satellite", lambda: V.satellite_history(versions(first_batch(t))), ())
    return V.satellite_append(before, versions(new_rows(t)))


@query("m04_satellite_late_versions", _SATELLITE)
def _(t):
    # The corrections are loaded before the first versions, which then come late.
    before = t.stored("satellite", lambda: V.satellite_history(versions(t.bronze_fixes())), ())
    return V.satellite_reload(before, versions(t.bronze()), versions(t.bronze_first()))


@query("m05_event_reference_link", """
SELECT sha256(length(trim(event_id)) || ':' || upper(trim(event_id)) || length(trim(reference_id))
    || ':' || upper(trim(reference_id))) AS l_event_reference_hk,
  tenant_id, sha256(upper(trim(event_id))) AS h_event_hk,
  sha256(upper(trim(reference_id))) AS h_reference_hk, load_dts, 'silver.events' AS record_source
FROM (SELECT tenant_id, event_id, reference_id, min(event_timestamp) AS load_dts FROM v_silver_2
  WHERE reference_id IS NOT NULL GROUP BY ALL)
ANTI JOIN (SELECT tenant_id, event_id, reference_id FROM v_silver_1)
USING (tenant_id, event_id, reference_id)""")
def _(t):
    return V.link_load(V.link_rows(silver_1(t)), silver_2(t))


@query("m06_register_if_absent", f"""
SELECT * FROM v_registry UNION ALL
SELECT 'supp-' || s_suppkey, 'supp-' || s_suppkey, 'dev', 'PENDING',
  TIMESTAMP '{ORDERS_AS_OF}', NULL, NULL, NULL FROM supplier""")
def _(t):
    known = t.registry()
    new = t.raw("supplier").select(F.concat(F.lit("supp-"), F.col("s_suppkey")).alias("tenant_id"))
    applied = known.select("tenant_id").unionByName(new)
    return L.register(known, applied, ts(ORDERS_AS_OF), F.lit("dev"))


_READY = """SELECT tenant_id, max(change_timestamp) AS ready_at FROM v_log
  WHERE change_type = 'QUALITY_SCAFFOLDED' GROUP BY ALL"""


@query("m07_activate_if_present", f"""
SELECT r.tenant_id, display_name, env,
  CASE WHEN ready_at IS NOT NULL THEN 'ACTIVE' ELSE state END AS state, created_at,
  coalesce(ready_at, activated_at) AS activated_at, deactivated_at, deactivation_reason
FROM v_registry r LEFT JOIN ({_READY}) USING (tenant_id)""")
def _(t):
    ready = (
        t.change_log().filter(F.col("change_type") == "QUALITY_SCAFFOLDED")
        .groupBy("tenant_id").agg(F.max("change_timestamp").alias("activated_at")))
    strangers = t.raw("supplier").select(
        F.concat(F.lit("supp-"), F.col("s_suppkey")).alias("tenant_id"),
        ts(ORDERS_AS_OF).alias("activated_at"))
    return L.activate(t.registry(), ready.unionByName(strangers))


@query("m08_dashboard_registration", f"""
WITH wanted AS (SELECT tenant_id, unnest({sql_list(S.DASHBOARD_TEMPLATES)}) AS template_name
  FROM v_registry WHERE state = 'ACTIVE'),
known AS (SELECT tenant_id, unnest({sql_list(S.DASHBOARD_TEMPLATES[:2])}) AS template_name
  FROM v_registry)
SELECT coalesce(k.tenant_id, w.tenant_id) AS tenant_id,
  coalesce(k.template_name, w.template_name) AS template_name,
  'native:' || coalesce(k.tenant_id, w.tenant_id) || ':' ||
    coalesce(k.template_name, w.template_name) AS dashboard_id,
  CASE WHEN k.tenant_id IS NULL THEN 'prod' ELSE 'dev' END AS env,
  CASE WHEN w.tenant_id IS NULL THEN TIMESTAMP '1995-01-01' ELSE TIMESTAMP '{ORDERS_AS_OF}' END
    AS registered_at, 'native' AS dashboard_type
FROM known k FULL JOIN wanted w ON k.tenant_id = w.tenant_id
  AND k.template_name = w.template_name""")
def _(t):
    registry = t.registry()
    known = L.dashboard_rows(registry, ts("1995-01-01"), F.lit("dev"), S.DASHBOARD_TEMPLATES[:2])
    active = registry.filter(F.col("state") == "ACTIVE")
    return L.register_dashboards(
        known, L.dashboard_rows(active, ts(ORDERS_AS_OF), F.lit("prod")))


@query("m09_contract_registration", f"""
SELECT tenant_id, layer, 'dq/expectations/' || tenant_id || '/' || layer || '_contract.yml'
  AS contract_path, CASE WHEN state = 'ACTIVE' AND layer = 'bronze' THEN TIMESTAMP '1995-01-01'
  ELSE TIMESTAMP '{ORDERS_AS_OF}' END AS created_at, true AS is_active
FROM (SELECT tenant_id, state, unnest({sql_list(S.CONTRACT_LAYERS)}) AS layer FROM v_registry)""")
def _(t):
    registry = t.registry()
    active = registry.filter(F.col("state") == "ACTIVE")
    known = L.contract_rows(active, ts("1995-01-01"), ["bronze"])
    return L.register_contracts(known, L.contract_rows(registry, ts(ORDERS_AS_OF)))


@query("m10_deactivate_tenants", f"""
SELECT tenant_id, display_name, env, CASE WHEN state = 'FAILED' THEN 'ROLLBACK' ELSE state END
  AS state, created_at, activated_at, CASE WHEN state = 'FAILED' THEN TIMESTAMP '{ORDERS_AS_OF}'
  END AS deactivated_at, CASE WHEN state = 'FAILED' THEN 'onboarding failed' END
  AS deactivation_reason FROM v_registry""")
def _(t):
    return L.deactivate(t.registry(), F.col("state") == "FAILED", ts(ORDERS_AS_OF),
                        F.lit("onboarding failed"))


@query("m10_deactivate_contracts", f"""
SELECT tenant_id, layer, 'dq/expectations/' || tenant_id || '/' || layer || '_contract.yml'
  AS contract_path, TIMESTAMP '{ORDERS_AS_OF}' AS created_at, state <> 'FAILED' AS is_active
FROM (SELECT tenant_id, state, unnest({sql_list(S.CONTRACT_LAYERS)}) AS layer FROM v_registry)""")
def _(t):
    registry = t.registry()
    contracts = L.contract_rows(registry, ts(ORDERS_AS_OF))
    return L.deactivate_contracts(contracts, registry.filter(F.col("state") == "FAILED"))


@query("m11_silver_without_bronze", f"""
SELECT s.tenant_id, count(*) AS orphans FROM v_silver s ANTI JOIN
  (SELECT * FROM v_bronze WHERE _ingested_at <= TIMESTAMP '{FIRST_RUN}') b
  USING (tenant_id, event_id) GROUP BY ALL""")
def _(t):
    orphans = insert_absent(first_batch(t), t.silver, SV.KEYS)
    return orphans.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("orphans"))


@query("m12_scalar_watermark", """
SELECT event_id, _ingested_at, _batch_id FROM v_bronze WHERE tenant_id = 'tenant-2'
  AND _ingested_at > (SELECT coalesce(max(last_updated_at), TIMESTAMP '2000-01-01') FROM v_marks
    WHERE tenant_id = 'tenant-2' AND table_name = 'events')""")
def _(t):
    mark = first_marks(t).filter(
        (F.col("tenant_id") == "tenant-2") & (F.col("table_name") == "events")
    ).agg(F.coalesce(F.max("last_updated_at"), ts(SV.EPOCH)))
    return t.bronze().filter(
        (F.col("tenant_id") == "tenant-2") & (F.col("_ingested_at") > mark.scalar())
    ).select("event_id", "_ingested_at", "_batch_id")


@query("m13_tenant_template_expansion", f"""
SELECT tenant_id, template_name, 'native:' || tenant_id || ':' || template_name AS dashboard_id
FROM (SELECT tenant_id, unnest({sql_list(S.DASHBOARD_TEMPLATES)}) AS template_name
  FROM v_registry)""")
def _(t):
    return L.dashboard_rows(t.registry(), ts(AS_OF), F.lit("dev")).select(
        "tenant_id", "template_name", "dashboard_id")


# --- Streams ----------------------------------------------------------------------------
@query("x02_bronze_to_silver_stream", "SELECT * FROM v_silver_2")
def _(t):
    bronze, silver = new_path(t.spark, "bronze"), new_path(t.spark, "silver")
    checkpoint = new_path(t.spark, "stream")
    rows, cut = t.bronze(), F.col("_ingested_at") <= ts(FIRST_RUN)
    for part, run in ((rows.filter(cut), FIRST_RUN), (rows.filter(~cut), SECOND_RUN)):
        B.append_bronze(part, bronze, run)
        silver_stream(t.spark, bronze, silver, checkpoint, ts(run)).awaitTermination()
    return read_table(t.spark, silver, S.SILVER_EVENTS)


# A version is late when it arrives five days after its day's end; a day closes when the newest event in time is as far.
VIEWS["v_in_time"] = """
SELECT * FROM v_typed WHERE event_timestamp <= _ingested_at
  AND _ingested_at < date_trunc('day', event_timestamp) + INTERVAL 6 DAY"""
VIEWS["v_closed"] = f"""
SELECT tenant_id, CAST(event_timestamp AS DATE) AS event_date, event_type, status,
  count(*) AS event_count, count(DISTINCT reference_id) AS unique_references,
  min(event_timestamp) AS first_event_ts, max(event_timestamp) AS last_event_ts
FROM (SELECT f.* EXCLUDE (status), CASE WHEN f.status IS NOT NULL THEN l.status END AS status
  FROM (SELECT * FROM v_in_time QUALIFY row_number() OVER (
      PARTITION BY tenant_id, event_id ORDER BY _ingested_at, _batch_id, status NULLS FIRST) = 1) f
  LEFT JOIN (SELECT * FROM v_in_time WHERE status IS NOT NULL QUALIFY row_number() OVER (
      PARTITION BY tenant_id, event_id ORDER BY _ingested_at DESC, _batch_id DESC, status DESC) = 1) l
    USING (tenant_id, event_id))
WHERE date_trunc('day', event_timestamp) + INTERVAL 6 DAY <= (SELECT max(event_timestamp) FROM v_in_time)
GROUP BY ALL"""
_ARRIVALS = (FIRST_RUN, "2024-01-24 00:00:00", SECOND_RUN)


def _streamed_by_arrival(t: Tables, start, schema):
    """Bronze written in three loads by arrival, the stream run after each."""
    bronze, out, checkpoint = (new_path(t.spark, name) for name in ("bronze", "streamed", "stream"))
    rows, last = t.bronze(), None
    for load in _ARRIVALS:
        part = F.col("_ingested_at") <= ts(load) if load != SECOND_RUN else F.lit(True)
        B.append_bronze(rows.filter(part if last is None else part & (F.col("_ingested_at") > ts(last))), bronze, load)
        finished(start(t.spark, bronze, out, checkpoint))
        last = load
    return read_table(t.spark, out, schema)


@query("x04_daily_kpi_closed_days", "SELECT * FROM v_closed")
def _(t):
    return _streamed_by_arrival(t, daily_kpi_stream, S.DAILY_KPI)


@query("x04_rows_set_aside", """
SELECT tenant_id, event_id, _batch_id, _ingested_at,
  CASE WHEN event_timestamp > _ingested_at THEN 'ahead' ELSE 'late' END AS reason
FROM v_typed WHERE event_timestamp > _ingested_at
  OR _ingested_at >= date_trunc('day', event_timestamp) + INTERVAL 6 DAY""")
def _(t):
    return _streamed_by_arrival(t, set_aside_stream, S.SET_ASIDE_EVENTS).select(
        "tenant_id", "event_id", "_batch_id", "_ingested_at", "reason")


# --- Keys, ids and texts ----------------------------------------------------------------
@query("p14_hash_keys", "SELECT event_id, sha256(upper(trim(event_id))) AS h_event_hk FROM v_silver")
def _(t):
    return t.silver.select("event_id", X.hash_key("event_id").alias("h_event_hk"))


@query("p15_hash_diff", f"SELECT event_id, {_FINGERPRINT} AS hash_diff FROM v_silver")
def _(t):
    return t.silver.select(
        "event_id", X.hash_diff("status", "reference_id", "event_type").alias("hash_diff"))


@query("p19_safe_tenant_id", """
SELECT tenant_id, 'gold_' || replace(tenant_id, '-', '_') AS gold_schema FROM v_registry""")
def _(t):
    return t.registry().select(
        "tenant_id", F.concat(F.lit("gold_"), X.safe_id("tenant_id")).alias("gold_schema"))


@query("p20_p23_composed_ids", """
SELECT tenant_id, 'native:' || tenant_id || ':kpi_overview' AS dashboard_id,
  'dq/expectations/' || tenant_id || '/silver_contract.yml' AS contract_path, 'silver' AS layer,
  '#dq-' || tenant_id AS alert_channel, '#tenant-' || tenant_id || '-updates' AS updates_channel
FROM v_registry""")
def _(t):
    path = X.contract_path("tenant_id", F.lit("silver"))
    return t.registry().select(
        "tenant_id", X.dashboard_id("tenant_id", F.lit("kpi_overview")).alias("dashboard_id"),
        path.alias("contract_path"), X.layer_of_path(path).alias("layer"),
        X.alert_channel("tenant_id").alias("alert_channel"),
        X.updates_channel("tenant_id").alias("updates_channel"))


@query("p21_change_lines", """
SELECT tenant_id, '- ' || strftime(change_timestamp, '%Y-%m-%d %H:%M:%S') || ': [' ||
  coalesce(component, 'unknown component') || '] ' || description AS line FROM v_log""")
def _(t):
    return t.change_log().select(
        "tenant_id", X.change_line("change_timestamp", "component", "description").alias("line"))


# --- Change-log look-ups ----------------------------------------------------------------
@query("o04_latest_changes", """
SELECT tenant_id, change_timestamp, change_type, component, description FROM v_log
ORDER BY change_timestamp DESC, description LIMIT 20""")
def _(t):
    return t.change_log().select(
        "tenant_id", "change_timestamp", "change_type", "component", "description"
    ).orderBy(F.desc("change_timestamp"), "description").limit(20)


@query("o04_tenant_history", """
SELECT r.tenant_id, r.state, r.env, l.change_timestamp, l.change_type, l.description
FROM v_registry r JOIN v_log l USING (tenant_id) WHERE r.tenant_id = 'cust-7'""")
def _(t):
    mine = F.col("tenant_id") == "cust-7"
    return (
        t.registry().filter(mine).select("tenant_id", "state", "env")
        .join(t.change_log().filter(mine).select(
            "tenant_id", "change_timestamp", "change_type", "description"), "tenant_id")
        .orderBy("change_timestamp", "description"))
