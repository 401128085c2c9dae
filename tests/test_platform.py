"""Deviation, governance, promotion, changelog and streams."""

import fnmatch
import json
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.operators import changelog as C
from stratalake.operators import deviation as V
from stratalake.operators import governance as G
from stratalake.operators import promotion as P
from stratalake.operators import silver as SV
from stratalake.session import new_path
from stratalake.sources import bronze as B
from stratalake.sources.inventory import column_inventory, session_tables
from stratalake.plans import gold as G_
from stratalake.sources.publish import append_once, full_refresh, read_table, replace_partitions
from stratalake.registry import QUERIES
from stratalake.streaming.ingest import bronze_stream, silver_stream

T0 = datetime(2024, 1, 1)


# --- Deviation --------------------------------------------------------------------------
def test_deviation_of_a_tenant_with_three_extra_fields(spark):
    sent = {"event_id": "STRING", "event_type": "STRING", "event_timestamp": "TIMESTAMP",
            "source_system": "STRING", "status": "STRING", "reference_id": "STRING",
            "approval_tier": "STRING", "vendor_code": "STRING", "amount_usd": "DOUBLE"}
    fields = spark.createDataFrame(
        [("north-corp", f, t) for f, t in sent.items()], "tenant_id string, field string, type string")
    full = V.reports(V.deviations(fields, platform_fields=True)).first()
    assert full.extra_fields == ["amount_usd", "approval_tier", "vendor_code"]
    assert full.missing_fields == ["_batch_id", "created_at", "last_updated_at", "tenant_id"]
    assert full.type_mismatches == []
    assert V.reports(V.deviations(fields)).first().missing_fields == []


def test_type_mismatch_and_unknown_type(spark):
    fields = spark.createDataFrame(
        [("t", "status", "bigint"), ("t", "event_id", None), ("t", "event_type", "string")],
        "tenant_id string, field string, type string")
    got = {(r.field, r.expected, r.actual)
           for r in V.deviations(fields).filter("kind = 'type_mismatch'").collect()}
    assert got == {("status", "STRING", "BIGINT"), ("event_id", "STRING", "UNKNOWN")}


def bronze_rows(spark, payloads):
    rows = [("t", f"e{i}", "review", T0, "erp", p if isinstance(p, str) else json.dumps(p),
             T0 + timedelta(minutes=i), "f", "b") for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, S.BRONZE_EVENTS)


def test_precise_types(spark):
    bronze = bronze_rows(spark, [
        {"status": "pending", "n": 1, "x": 1.5, "d": "2024-01-05", "at": "2024-01-05 10:00:00",
         "s": "7a"},
        {"status": "odd", "n": 22, "x": 2, "d": "2024-02-05", "at": "2024-01-05T10:00:00", "s": "7"},
        "not json at all",
    ])
    fields = V.source_fields(bronze)
    types = {r.field: r.type for r in fields.collect()}
    assert {k: types[k] for k in ("n", "x", "d", "at", "s")} == {
        "n": "BIGINT", "x": "DOUBLE", "d": "DATE", "at": "TIMESTAMP", "s": "STRING"}
    assert V.custom_states(SV.silver_projection(bronze)).first().status == "odd"


def test_adapted_silver_keeps_the_types_of_each_tenant(spark):
    bronze = bronze_rows(spark, [{"status": "pending", "priority": 7, "at": "2024-01-05 10:00:00"}, "{"]).unionByName(
        bronze_rows(spark, [{"status": "done", "priority": "P7", "x": "1.5"}]).withColumn("tenant_id", F.lit("u")))
    rows = V.adapted_silver(bronze, V.deviations(V.source_fields(bronze)), F.lit(T0))
    assert set(S.SILVER_EVENTS.fieldNames()) | {"extras"} <= set(rows.columns)
    got = {(r.tenant_id, r.event_id): r for r in rows.withColumn(
        "kinds", F.expr("transform_values(extras, (f, v) -> schema_of_variant(v))")).collect()}
    assert got["t", "e0"].kinds["priority"] == "BIGINT" and got["u", "e0"].kinds["priority"] == "STRING"
    assert got["t", "e0"].kinds["at"].startswith("TIMESTAMP") and got["u", "e0"].kinds["x"] == "DOUBLE"
    assert set(got["u", "e0"].kinds) == {"priority", "x"} and not got["t", "e1"].extras
    assert got["t", "e0"].created_at == got["t", "e0"].last_updated_at == T0


def test_unreadable_time_becomes_null(spark):
    bronze = bronze_rows(spark, [{}, {}]).withColumn(
        "event_timestamp", F.when(F.col("event_id") == "e0", "2024-01-05 10:00:00").otherwise("soon"))
    times = {r.event_id: r.event_timestamp for r in SV.silver_projection(bronze).collect()}
    assert times == {"e0": datetime(2024, 1, 5, 10), "e1": None}


def test_profiles_of_parts_merge_in_any_order(spark):
    sent = [{"a": 1, "b": "2024-01-05"}, {"a": 2.5}, "{", {"a": None, "c": "x"}, {"b": "soon"}, {}]
    bronze = bronze_rows(spark, sent).unionByName(bronze_rows(spark, ["{", "{}"]).withColumn("tenant_id", F.lit("u")))
    whole = sorted(map(str, V.source_fields(bronze).collect()))
    parts = [V.field_profile(bronze.filter(F.crc32("event_id") % 3 == i)) for i in (2, 0, 1)]
    merged = V.merged_profile(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert sorted(map(str, V.profile_fields(merged).collect())) == whole
    again = V.merged_profile(merged.unionByName(parts[1]))
    assert sorted(map(str, V.profile_fields(again).collect())) == whole
    assert {"tenant_id='u'" in r for r in whole} == {True, False}


def test_windows_bound_the_scan_before_the_join(spark):
    path = new_path(spark, "bronze")
    rows = spark.createDataFrame([("t", f"e{d}", "review", T0, "erp", "{}", T0 + timedelta(weeks=d), "f", "b") for d in range(12)], S.BRONZE_EVENTS)
    B.append_bronze(rows, path, "1")
    deployed = spark.createDataFrame([("t", 1, T0 + timedelta(weeks=6))], "tenant_id string, category_id int, deployed_at timestamp")
    got = P.window_metrics(read_table(spark, path, S.BRONZE_STORED), deployed, F.lit(24 * 8), F.lit(False), F.lit(False))
    assert (got.first().rows_before, got.first().rows_after) == (1, 2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ingest_week" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0] and "GreaterThanOrEqual(_ingested_at" in plan
    assert P.window_metrics(rows, deployed.limit(0), F.lit(24), F.lit(False), F.lit(False)).count() == 0


def test_vendor_tier_counts_each_row_once(spark):
    rows = [("t", v, "x", e, w, a) for v, e, w, a in [
        ("v", "e1", "w1", "10"), ("v", "e1", "w2", "20"), ("v", "e1", "w1", None), ("v", "e2", None, "5"), ("v", None, "w3", "bad"), ("n", None, None, None)]]
    df = spark.createDataFrame(rows, "tenant_id string, vendor_code string, approval_tier string, event_id string, workflow_id string, amount_usd string")
    out = G_.vendor_tier(df)
    got = {r.vendor_code: (r.events, r.workflows, r.avg_amount_usd, r.total_amount_usd) for r in out.collect()}
    assert got == {"v": (2, 3, 11.67, 35.0), "n": (0, 0, None, None)}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_reference_falls_back_to_workflow(spark):
    bronze = bronze_rows(spark, [{"reference_id": "R", "workflow_id": "W"}, {"workflow_id": "W"}, "{"])
    both = SV.silver_projection(bronze).orderBy("event_id").collect()
    assert [r.reference_id for r in both] == ["R", "W", None]
    own = SV.silver_projection(bronze, ("reference_id",)).orderBy("event_id").collect()
    assert [r.reference_id for r in own] == ["R", None, None]


# --- Promotion --------------------------------------------------------------------------
PATHS = ["a/b.py", "orchestrator/x/y.py", "x.grants.sql", "db/x.grants.sql", "db/a/x.rls.sql",
         "dbt/models/gold_north/kpi.sql", "models/gold_x/a/b.sql", "dbt/models/goldnorth/k.sql",
         "AGENTS.md", "docs/AGENTS.md", "templates/dashboards/a.json", "dbt/models/silver/x/y.sql"]


def test_patterns_match_like_shell_patterns():
    for globs in P.FILE_GLOBS.values():
        for g in globs:
            for path in PATHS:
                assert bool(re.match(P.glob_regex(g), path)) == fnmatch.fnmatchcase(path, g), (g, path)


def test_path_expressions_match_like_shell_patterns(spark):
    paths = spark.createDataFrame([(p,) for p in PATHS], "path string")
    lists = [*P.FILE_GLOBS.values(), P.GOVERNANCE_PATHS, P.SHARED_PATHS, P.TENANT_MODEL_PATHS,
             P.TENANT_CONFIG_PATHS, ["*kpi*"], ["*.py", "docs/?GENTS.md"], ["*"]]
    rows = paths.select("path", *[P.path_in(g).alias(f"c{i}") for i, g in enumerate(lists)]).collect()
    for row in rows:
        for i, globs in enumerate(lists):
            expected = any(fnmatch.fnmatchcase(row.path, g) for g in globs)
            assert row[f"c{i}"] == expected, (row.path, globs)


def classified(spark, files, literal=False):
    df = spark.createDataFrame([(1, f) for f in files], "change_id int, path string")
    return P.classify_by_files(df, literal).first()


def test_classification_by_files(spark):
    assert classified(spark, ["README.md"])[2:4] == (2, 0.5)
    assert classified(spark, ["dbt/models/gold_a/k.sql"])[2:4] == (2, 1.0)
    shared = classified(spark, ["dbt/models/silver/a/b.sql", "dq/expectations/a/silver.yml"])
    assert shared[2:4] == (3, 1.0)
    mixed = classified(spark, ["dbt/models/silver/a.sql", "templates/dashboards/x.json"])
    assert (mixed.category_id, mixed.confidence, mixed.recommend_split) == (3, 0.7, True)
    assert mixed.ambiguity_note.startswith("Files of several categories changed: 1, 3.")
    assert classified(spark, ["some/new/file.txt"], literal=True)[2:4] == (5, 1.0)
    assert classified(spark, ["some/new/file.txt"])[2:4] == (2, 0.5)


@pytest.mark.parametrize("files,title,rule,category", [
    (["db/x.rls.sql", "dbt/models/silver/a.sql"], "", 1, 4),
    (["databricks.yml"], "[hotfix] x", 2, 4),
    (["templates/pipelines/vault_hub.sql.j2"], "", 3, 3),
    (["orchestrator/cli.py", "orchestrator/handlers/register_tenant.py"], "", 4, 3),
    (["orchestrator/handlers/register_tenant.py"], "", 5, 4),
    (["dbt/models/gold_a/k.sql"], "[emergency] x", 6, 5),
    (["dbt/models/gold_a/k.sql", "agents/a/x.py"], "", 7, 2),
    (["dbt/models/gold_a/k.sql", "dbt/models/gold_b/k.sql"], "", 7, 3),
    (["templates/dashboards/a.json"], "", 8, 1),
    (["README.md"], "", 9, 2),
])
def test_ordered_rules(spark, files, title, rule, category):
    f = spark.createDataFrame([(1, p) for p in files], "change_id int, path string")
    c = spark.createDataFrame([(1, title, "")], "change_id int, title string, body string")
    row = P.classify_by_rules(f, c).first()
    assert (row.rule_no, row.category_id) == (rule, category)
    assert row.confidence == (0.6 if rule == 9 else 0.95)


def test_readiness_needs_hold_canary_wait_teams_and_people(spark):
    def at(hours):
        return None if hours is None else T0 + timedelta(hours=hours)

    changes = [  # id, category, staged, canary, reviewed, checked; engineers of 3 as (person, team)
        (1, 3, 0, 25, None, 49, [("x", "data_engineering"), ("y", "platform_engineering")]),
        (2, 4, 0, None, None, 144, []),
        (3, 1, 0, None, None, 0.5, []),
        (4, 5, 0, None, None, 49, []),
        (5, 5, 0, None, 47, 49, []),
        (6, 5, 0, None, 60, 49, []),  # reviewed only later
        (7, 3, 0, 26, None, 49, [("x", "data_engineering"), ("y", "analytics_engineering")]),
        (8, 3, 0, None, None, 490, [("x", "data_engineering"), ("y", "data_engineering")]),
        (9, 3, 0, 24, None, 49, [("x", "data_engineering"), ("x", "platform_engineering")]),
        (10, 3, None, 24, None, 49, [("x", "data_engineering"), ("x", "platform_engineering"), ("y", None), ("z", "data_engineering")]),
    ]
    classes = spark.createDataFrame([c[:2] for c in changes], "change_id int, category_id int")
    rows = spark.createDataFrame(
        [(c[0], T0, at(c[2]), at(c[3]), at(c[4]), at(c[5])) for c in changes],
        "change_id int, opened_at timestamp, staged_at timestamp, canary_at timestamp, reviewed_at timestamp, checked_at timestamp")
    people = [(c[0], "engineer", *p) for c in changes for p in c[6] * 2]
    approvals = spark.createDataFrame(
        [*people, (2, "senior_engineer", "x", None), (2, "data_platform_lead", "y", None)],
        "change_id int, role string, approver string, team string")
    got = {r.change_id: r for r in P.readiness(classes, rows, approvals).collect()}
    assert got[1].ready
    assert (got[2].hold_done, got[2].wait_done, got[2].ready) == (True, False, False)
    assert (got[3].ready, got[3].sla_breached) == (True, False)
    assert (got[4].approvals_missing, got[4].review_overdue, got[4].sla_breached) == (1, True, True)
    assert (got[5].review_overdue, got[6].review_overdue) == (False, True)
    assert (got[7].canary_done, got[7].teams_done, got[7].ready) == (False, True, False)
    assert (got[8].hold_done, got[8].canary_done, got[8].teams_done, got[8].approvals_missing) == (True, False, False, 0)
    assert (got[9].canary_done, got[9].teams_done, got[9].approvals_missing) == (True, False, 1)
    assert (got[10].hold_done, got[10].teams_done, got[10].approvals_missing, got[10].ready) == (False, True, 0, False)


def test_canary_candidates(spark):
    registry = spark.createDataFrame(
        [(f"t{i}", "ACTIVE" if i != 3 else "PENDING") for i in range(6)],
        "tenant_id string, state string")
    volumes = spark.createDataFrame(
        [("t0", 100), ("t1", 119), ("t2", 121), ("t3", 100), ("t4", 80), ("t5", 90)],
        "tenant_id string, volume bigint")
    deviating = spark.createDataFrame([("t5",)], "tenant_id string")
    got = P.canary_candidates(P.typical_tenants(registry, volumes), deviating)
    assert {r.tenant_id for r in got.collect()} == {"t0", "t1", "t4"}


def test_schema_drift_alone_recommends_a_rollback(spark):
    from datetime import timedelta as span
    sent = [("t", -1, {"a": 1}), ("t", 1, {"a": 2}), ("u", -1, {"a": 1}), ("u", 1, {"a": 1, "b": 2}),
            ("v", -1, {"a": 1}), ("v", 1, {"a": "x"}), ("w", 1, {"a": 1}), ("x", -1, {"a": 1}), ("x", 1, {"a": 1}),
            ("x", 60, {"b": 1}), ("y", -1, {"a": 1}), ("y", 1, {"b": 1})]
    bronze = spark.createDataFrame(
        [(tenant, json.dumps({"status": "pending", "reference_id": "R", **more}), T0 + span(hours=h)) for tenant, h, more in sent],
        "tenant_id string, payload string, _ingested_at timestamp")
    deployed = spark.createDataFrame(
        [(tenant, 1 if tenant == "y" else 3, T0) for tenant in "tuvwxy"], "tenant_id string, category_id int, deployed_at timestamp")
    drift = P.schema_drift(bronze, deployed, F.lit(48))
    assert {r.tenant_id: r.schema_drift for r in drift.collect()} == {"t": False, "u": True, "v": True, "x": False, "y": True}
    metrics = P.window_metrics(bronze, deployed, F.lit(48), F.lit(False), F.lit(False)).join(drift, "tenant_id", "left")
    got = {r.tenant_id: r.reasons for r in P.rollback_recommendations(metrics, F.coalesce("schema_drift", F.lit(False))).collect()}
    assert got == {"t": [], "u": ["schema_drift"], "v": ["schema_drift"], "w": [], "x": [], "y": []}


def test_canary_candidates_leave_out_flagged_tenants(spark, monkeypatch):
    from stratalake.operators import deviation
    asked = []
    flags = deviation.deviation_flags
    monkeypatch.setattr(deviation, "deviation_flags", lambda *a: asked.append(1) or flags(*a))
    QUERIES["g12_canary_candidates"](spark, "/root/testdata/sf0.001")
    assert asked


def test_staging_comparison(spark):
    base = spark.createDataFrame([("t", 1, "a"), ("t", 2, "b"), ("t", 3, None)],
                                 "tenant_id string, k int, v string")
    new = spark.createDataFrame([("t", 1, "a"), ("t", 2, "c"), ("t", 4, None)],
                                "tenant_id string, k int, v string")
    good = spark.createDataFrame([("t", 100.0)], "tenant_id string, pass_rate_pct double")
    row = P.staging_comparison(new, base, ("tenant_id", "k"), good).first()
    assert (row.added, row.removed, row.changed, row.recommendation) == (1, 1, 1, "PROMOTE")
    moved = [spark.createDataFrame([("t", 1, *v)], "tenant_id string, k int, a string, b string")
             for v in ((None, "x"), ("x", None))]
    assert P.staging_comparison(*moved, ("tenant_id", "k"), good).first().changed == 1
    assert P.staging_comparison(moved[0], moved[0], ("tenant_id", "k"), good).first().changed == 0
    typed = new.withColumn("v", F.lit(1))
    row = P.staging_comparison(typed, base, ("tenant_id", "k"), good).first()
    assert (row.schema_drift, row.recommendation) == (True, "BLOCK")
    assert P.schema_differences(typed, base).first().column_name == "v"


# --- Governance -------------------------------------------------------------------------
def test_grants_and_isolation(spark):
    tenants = spark.createDataFrame([("a-b",)], "tenant_id string")
    grants = G.grant_rows(tenants, "main")
    assert grants.count() == 6
    assert grants.filter("principal = 'analysts_a_b'").first().statement == \
        "GRANT SELECT ON SCHEMA main.gold_a_b TO `analysts_a_b`"
    known = spark.createDataFrame([("sp-tenant-a_b",)], "principal string")
    assert G.grant_summary(G.grant_outcome(grants, known)).first().description == "5 applied, 1 skipped"
    rights = spark.createDataFrame([("p", "t1")], "principal string, tenant_id string")
    rows = spark.createDataFrame([("t1", 1), ("t2", 2)], "tenant_id string, v int")
    assert G.visible_rows(rows, rights, "p").collect() == [("t1", 1)]
    assert G.visible_rows(rows, rights, "q").count() == 0
    leaked = G.isolation_violations(rows.withColumn("principal", F.lit("p")), rights)
    assert leaked.collect() == [("p", "t2", 1)]


def test_activation_gate(spark):
    tenants = spark.createDataFrame([(f"t-{i}",) for i in range(4)], "tenant_id string")
    schemas = spark.createDataFrame([("gold_t_0",), ("gold_t_1",), ("gold_t_3",)],
                                    "schema_name string")
    contracts = spark.createDataFrame(
        [("t-0", True), ("t-0", True), ("t-1", False), ("t-2", True), ("t-3", True)],
        "tenant_id string, is_active boolean")
    alerts = spark.createDataFrame([("t-3", False), ("t-0", True)],
                                   "tenant_id string, resolved boolean")
    without = {r.tenant_id: r.reason for r in G.activation_gate(tenants, schemas, contracts).collect()}
    assert without == {"t-0": None, "t-1": "no active contract", "t-2": "gold schema missing",
                       "t-3": None}
    full = {r.tenant_id: (r.can_activate, r.reason)
            for r in G.activation_gate(tenants, schemas, contracts, alerts).collect()}
    assert full["t-0"] == (True, None)
    assert full["t-3"] == (False, "unresolved alert")


def test_row_filter_prunes_partitions(spark):
    path, rights_path = new_path(spark, "t"), new_path(spark, "rights")
    rows = spark.createDataFrame([(f"t{i}", i) for i in range(20)], "tenant_id string, v int")
    full_refresh(rows, path)
    rights = spark.createDataFrame([("p", "t3"), ("q", "t4")], "principal string, tenant_id string")
    full_refresh(rights, rights_path, ())
    seen = G.visible_rows(read_table(spark, path, rows.schema),
                          read_table(spark, rights_path, rights.schema), "p")
    assert "dynamicpruning" in seen._jdf.queryExecution().executedPlan().toString()
    assert seen.collect() == [("t3", 3)]


# --- Changelog --------------------------------------------------------------------------
def test_changelog_summary_and_leaks(spark):
    log = spark.createDataFrame(
        [("t-1", T0 + timedelta(days=d), k, None, f"d{d}", None, None, "dev")
         for d, k in [(1, "DASHBOARDS_SCAFFOLDED"), (20, "QUALITY_SCAFFOLDED"),
                      (21, "QUALITY_SCAFFOLDED"), (22, "OTHER")]],
        S.TENANT_CHANGE_LOG)
    registry = spark.createDataFrame([("t-1", "ACTIVE"), ("t-2", "ACTIVE")],
                                     "tenant_id string, state string")
    recent = C.recent_changes(log, registry, "2024-01-24", 7)
    assert recent.count() == 3
    assert C.change_texts(recent).first().changes.splitlines()[0] == \
        "- 2024-01-23 00:00:00: [unknown component] d22"
    text = C.summaries(C.summary_facts(recent), 7)
    assert text.first().summary == (
        "In the past 7 days, 3 changes were made to your data platform. 2 quality monitoring "
        "updates were made. Please contact your platform team if you have any questions.")
    assert C.leaks(text, registry).count() == 0
    bad = spark.createDataFrame(
        [("t-1", "As for T-2, the MERGE into silver.events of kpi_summary.")],
        "tenant_id string, summary string")
    assert {(r.word, r.kind) for r in C.leaks(bad, registry).collect()} == {
        ("t-2", "tenant"), ("merge", "technical"), ("silver.events", "technical"),
        ("kpi_summary", "technical")}
    one = C.recent_changes(log, registry, "2024-01-24", 90, k=1)
    assert [r.description for r in one.collect()] == ["d22"]


def test_leaks_spread_frequent_words(spark):
    """Words of every text do not meet in one task by the word, also where they name a tenant."""
    texts = spark.createDataFrame([(f"t{i}", f"The common text of own{i} and kpi_x.") for i in range(3000)], "tenant_id string, summary string")
    names = spark.createDataFrame([("Common",), ("own7",), ("absent",)], "tenant_id string")
    found = C.leaks(texts, names)
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.tenant_id, r.word, r.kind) for r in found.collect())
    assert got == sorted([(f"t{i}", w, k) for i in range(3000) for w, k in (("common", "tenant"), ("kpi_x", "technical"))] + [("t7", "own7", "tenant")])
    seen = C.leaks(texts, names.hint("merge"))  # no word of all texts goes through the sorted join
    assert seen.filter("kind = 'tenant'").count() == 3001


# --- Storage and streams ----------------------------------------------------------------
def test_replacing_partitions_keeps_the_others(spark):
    path = new_path(spark, "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, v int")
    full_refresh(df, path)
    own = read_table(spark, path, df.schema).filter("tenant_id = 'a'")
    replace_partitions(own.withColumn("v", F.col("v") + 10), path)
    assert sorted(read_table(spark, path, df.schema).collect()) == [("a", 11), ("b", 2)]
    full_refresh(df.filter("tenant_id = 'b'"), new := new_path(spark, "t"))
    assert read_table(spark, new, df.schema).collect() == [("b", 2)]
    assert read_table(spark, new_path(spark, "none"), df.schema).count() == 0


def test_broken_lines_go_to_the_rejects(spark):
    landing, bronze, rejects = (new_path(spark, n) for n in ("landing", "bronze", "rejects"))
    event = {"event_id": "e1", "event_type": "review", "event_timestamp": "2024-01-05T10:00:00.000000Z", "payload": "{}"}
    good, late = json.dumps(event), json.dumps({**event, "event_id": "e2", "event_timestamp": "soon"})
    both = json.dumps([{**event, "event_id": "e3"}, {**event, "event_id": "e4"}])
    bad = [good[:40], "plain text", '{"other": 1}', "[]", "[1, 2", json.dumps([event, {"other": 2}])]
    lines = spark.createDataFrame([("t", v) for v in [good, "", late, both, *bad]], "tenant_id string, value string")
    lines.coalesce(1).write.partitionBy("tenant_id").text(landing)
    bronze_stream(spark, landing, bronze, new_path(spark, "c"), F.lit("b"), rejects=rejects).awaitTermination()
    kept = [(B.read_landing(spark, landing, "b"), B.read_rejects(spark, landing, "b")),
            (read_table(spark, bronze, S.BRONZE_EVENTS), read_table(spark, rejects, S.LANDING_REJECTS))]
    for events, rest in kept:
        assert sorted(r.event_id for r in events.collect()) == ["e1", "e1", "e2", "e3", "e4"]
        rows = rest.collect()
        assert sorted(r.raw for r in rows) == sorted([late, *bad])
        assert all(r.tenant_id == "t" and r._source_file and r._batch_id == "b" for r in rows)
        assert {r.event_id for r in events.collect() if r.event_timestamp is None} == {"e2"}


def test_streams_equal_batch_and_can_be_repeated(spark):
    rows = bronze_rows(spark, [{"status": s, "reference_id": "R"} for s in "abcd"])
    landing, bronze, silver = (new_path(spark, n) for n in ("landing", "bronze", "silver"))
    marks = [new_path(spark, "c1"), new_path(spark, "c2")]

    def run():
        bronze_stream(spark, landing, bronze, marks[0], F.lit("b"), max_files=1).awaitTermination()
        silver_stream(spark, bronze, silver, marks[1], F.lit(T0), max_files=1).awaitTermination()
        got = read_table(spark, silver, S.SILVER_EVENTS).collect()
        return {r.event_id: (r.status, r.created_at) for r in got}

    B.write_landing(rows.repartition(2), landing)
    first = run()
    assert first == {f"e{i}": (s, T0) for i, s in enumerate("abcd")}
    assert run() == first
    later = rows.limit(1).withColumn("payload", F.lit('{"status": "z"}'))
    B.write_landing(later, landing)
    assert run() == {**first, "e0": ("z", T0)}
    assert read_table(spark, bronze, S.BRONZE_EVENTS).count() == 5
    replay = [new_path(spark, "c3"), new_path(spark, "s2")]
    silver_stream(spark, bronze, replay[1], replay[0], F.lit(T0)).awaitTermination()
    assert read_table(spark, replay[1], S.SILVER_EVENTS).count() == 4


def test_a_load_is_appended_once(spark):
    path, df = new_path(spark, "sink"), spark.createDataFrame([("a", 1), ("b", 2)], "tenant_id string, v int")
    assert append_once(df, path, "l1") and not append_once(df, path, "l1")
    # A load that broke off before its ledger row replaces what it left.
    replace_partitions(df.limit(1).withColumn("load_id", F.lit("l2")), path, ("tenant_id", "load_id"))
    assert append_once(df, path, "l2")
    assert sorted(read_table(spark, path, df.schema).collect()) == [("a", 1), ("a", 1), ("b", 2), ("b", 2)]


def test_inventory(spark):
    df = spark.createDataFrame([], S.SILVER_EVENTS)
    cols = column_inventory(spark, {("silver", "events"): df})
    assert cols.filter("column_name = 'status'").first()[2:] == (6, "status", "STRING", "YES")
    df.createOrReplaceTempView("inventory_probe")
    assert session_tables(spark, "inventory%").count() == 1
