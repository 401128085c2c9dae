"""Classification of changes, promotion readiness, rollback and canary rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.functions.selection import weighted_median
from stratalake.functions.scalars import pct
from stratalake.operators.anomaly import change_pct
from stratalake.operators.deviation import deviations, source_fields

# --- Fixed values: the five change categories and their file patterns -------------------
CATEGORIES = [
    # id, name, path, sla h, staging hold h, canary hold h, wait days, review h, window h,
    # dq failure %, row delta %, schema drift counts, runbook
    (1, "Tenant config changes", ["dev", "staging", "prod"], 1.0, 0, 0, 0, None, 24,
     5.0, 20.0, False, "promotion/runbooks/rollback_tenant_config.md"),
    (2, "Tenant-specific model changes", ["dev", "staging", "prod"], 24.0, 4, 0, 0, None, 12,
     10.0, 30.0, False, "promotion/runbooks/rollback_tenant_model.md"),
    (3, "Shared-layer changes", ["dev", "staging", "canary", "prod"], 120.0, 24, 24, 0, None, 48,
     2.0, 10.0, True, "promotion/runbooks/rollback_shared_layer.md"),
    (4, "Governance changes", ["dev", "staging", "prod"], 240.0, 24, 0, 7, None, 0,
     None, None, False, "promotion/runbooks/rollback_governance.md"),
    (5, "Emergency hotfix", ["prod"], 0.5, 0, 0, 0, 48, 4,
     None, None, False, "promotion/runbooks/rollback_hotfix.md"),
]
CATEGORY_COLUMNS = (
    "category_id int, category_name string, promotion_path array<string>, sla_hours double, "
    "staging_hold_hours int, canary_hold_hours int, mandatory_wait_days int, "
    "retroactive_review_hours int, rollback_window_hours int, dq_failure_limit_pct double, "
    "row_delta_limit_pct double, drift_blocks boolean, rollback_runbook string"
)
APPROVERS = {
    1: {}, 2: {"engineer": 1}, 3: {"engineer": 2},
    4: {"senior_engineer": 1, "data_platform_lead": 1}, 5: {"senior_engineer_oncall": 1},
}
# Shared-layer changes: the reviewers come from two teams, one of each group.
TWO_TEAM_CATEGORIES = [3]
REVIEW_TEAMS = (["data_engineering"], ["analytics_engineering", "platform_engineering"])
FILE_GLOBS = {
    1: ["orchestrator/handlers/register_tenant.py", "orchestrator/handlers/provision_grants.py",
        "orchestrator/handlers/scaffold_dashboards.py",
        "orchestrator/handlers/scaffold_quality.py", "orchestrator/handlers/activate_tenant.py",
        "templates/dashboards/**", "templates/quality_contracts/**"],
    2: ["templates/pipelines/gold_analytics.sql.j2", "models/gold_*/**", "dbt/models/gold_*/**"],
    3: ["templates/pipelines/bronze_ingestion.sql.j2", "templates/pipelines/silver_merge.sql.j2",
        "templates/pipelines/vault_hub.sql.j2", "dbt/models/bronze/**", "dbt/models/silver/**",
        "dbt/models/vault/**", "dbt/models/feature_store/**", "orchestrator/**"],
    4: ["AGENTS.md", "promotion/categories.yml", "**/*.grants.sql", "**/*.rls.sql",
        "orchestrator/handlers/register_tenant.py", "orchestrator/handlers/provision_grants.py",
        "databricks.yml"],
    5: ["**/*"],
}
GOVERNANCE_PATHS = ["AGENTS.md", "promotion/categories.yml", "*.grants.sql", "*.rls.sql"]
ROOT_CONFIG = ["databricks.yml"]
SHARED_PATHS = [
    "templates/pipelines/bronze_*", "templates/pipelines/silver_*", "templates/pipelines/vault_*",
    "dbt/models/bronze/**", "dbt/models/silver/**", "dbt/models/vault/**",
    "dbt/models/feature_store/**",
]
ORCHESTRATOR_PATHS = ["orchestrator/**"]
ONBOARDING_PATHS = [
    "orchestrator/handlers/register_tenant.py", "orchestrator/handlers/provision_grants.py"]
TENANT_MODEL_PATHS = ["dbt/models/gold_*/**", "agents/**", "templates/quality_contracts/**"]
TENANT_CONFIG_PATHS = [
    "templates/dashboards/**", "orchestrator/handlers/scaffold_dashboards.py",
    "orchestrator/handlers/activate_tenant.py"]
URGENT_TAGS = r"\[(hotfix|emergency)\]"
TENANT_IN_PATH = r"^(?:dbt/models/gold_|agents/|templates/quality_contracts/)([^/.]+)"
CANARY_LIMITS = {"null_rate_pct": 2.0, "row_count_delta_pct": 10.0, "unexpected_pct": 5.0}
CANARY_HOLD_HOURS = 24
CANARY_VOLUME_PCT = 20
# ----------------------------------------------------------------------------------------


def glob_regex(pattern: str) -> str:
    """Shell pattern as a regular expression; a star also crosses folders."""
    out = []
    for token in re.findall(r"\*+|\?|[^*?]+", pattern):
        out.append(".*" if token[0] == "*" else "." if token == "?" else re.escape(token))
    return "(?s)^" + "".join(out) + "$"


def path_in(patterns: Sequence[str], path: str = "path") -> Column:
    """Whether a path matches any pattern; a plain expression, so no join is needed.

    Patterns without stars compare by value and those with stars at one end by prefix
    or suffix; only the rest needs a regular expression.
    """
    column = F.col(path)
    names = [p for p in patterns if not re.search(r"[*?]", p)]
    tests = [column.isin(names)] if names else []
    regexes = []
    for pattern in patterns:
        body = pattern.strip("*")
        if pattern in names:
            continue
        if re.search(r"[*?]", body) or not body:
            regexes.append(glob_regex(pattern))
        elif not pattern.startswith("*"):
            tests.append(column.startswith(body))
        elif not pattern.endswith("*"):
            tests.append(column.endswith(body))
        else:
            tests.append(column.contains(body))
    if regexes:
        tests.append(column.rlike("|".join(regexes)))
    return reduce(lambda x, y: x | y, tests)


def categories(spark: SparkSession) -> DataFrame:
    """The fixed categories as rows, built from literals inside Spark."""
    fields = [part.split(" ", 1) for part in CATEGORY_COLUMNS.split(", ")]

    def literal(value, kind: str) -> Column:
        whole = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
        return whole.cast(kind)

    rows = [
        F.struct(*[literal(v, kind).alias(name) for v, (name, kind) in zip(row, fields)])
        for row in CATEGORIES
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def any_file(condition: Column) -> Column:
    return F.max(F.when(condition, 1).otherwise(0)) == 1


def all_files(condition: Column) -> Column:
    return F.min(F.when(condition, 1).otherwise(0)) == 1


def matched_categories(files: DataFrame, literal: bool = False) -> DataFrame:
    """Categories whose patterns any file of a change matches, as a sorted list.

    The hotfix pattern matches every path in a folder. It only takes part in
    ``literal`` mode; otherwise hotfixes are told by their title.
    """
    ids = [c for c in FILE_GLOBS if literal or c != 5]
    flags = [any_file(path_in(FILE_GLOBS[c])).alias(f"_c{c}") for c in ids]
    hits = F.array_compact(F.array(*[F.when(F.col(f"_c{c}"), c) for c in ids]))
    return files.groupBy("change_id").agg(*flags).select("change_id", hits.alias("matched"))


def classify_by_files(files: DataFrame, literal: bool = False) -> DataFrame:
    """Highest matched category; certain only when exactly one matched."""
    n = F.size("matched")
    highest = F.element_at("matched", -1)
    note = F.format_string(
        "Files of several categories changed: %s. Category %d applies as the riskiest of them. "
        "Unless they depend on each other, promote them one by one.",
        F.array_join(F.col("matched").cast("array<string>"), ", "), highest)
    shared = F.array_contains("matched", 3) | F.array_contains("matched", 4)
    own = F.array_contains("matched", 1) | F.array_contains("matched", 2)
    return matched_categories(files, literal).select(
        "change_id", "matched",
        F.when(n == 0, 2).otherwise(F.try_element_at("matched", F.lit(-1))).alias("category_id"),
        F.when(n == 0, 0.5).when(n == 1, 1.0).otherwise(0.7).alias("confidence"),
        F.when(n > 1, note).alias("ambiguity_note"),
        (shared & own).alias("recommend_split"),
    )


def classify_by_rules(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Ordered decision rules; the first that holds decides."""
    onboarding = path_in(ONBOARDING_PATHS)
    tenant = F.nullif(F.regexp_extract("path", TENANT_IN_PATH, 1), F.lit(""))
    facts = files.groupBy("change_id").agg(
        any_file(path_in(GOVERNANCE_PATHS)).alias("r1"),
        any_file(path_in(ROOT_CONFIG)).alias("r2"),
        any_file(path_in(SHARED_PATHS)).alias("r3"),
        any_file(path_in(ORCHESTRATOR_PATHS) & ~onboarding).alias("r4"),
        any_file(onboarding).alias("r5"),
        all_files(path_in(TENANT_MODEL_PATHS)).alias("r7"),
        (F.min(tenant) == F.max(tenant)).alias("one_tenant"),
        all_files(path_in(TENANT_CONFIG_PATHS)).alias("r8"),
    )
    urgent = F.concat_ws(" ", "title", "body").rlike(URGENT_TAGS)
    rows = changes.select("change_id", urgent.alias("r6")).join(facts, "change_id")
    one = F.coalesce("one_tenant", F.lit(False))
    ordered = [(F.col("r1"), 1, F.lit(4)), (F.col("r2"), 2, F.lit(4)), (F.col("r3"), 3, F.lit(3)),
               (F.col("r4"), 4, F.lit(3)), (F.col("r5"), 5, F.lit(4)), (F.col("r6"), 6, F.lit(5)),
               (F.col("r7"), 7, F.when(one, 2).otherwise(3)), (F.col("r8"), 8, F.lit(1))]
    rule, category = F.lit(9), F.lit(2)
    for holds, number, result in reversed(ordered):
        rule = F.when(holds, number).otherwise(rule)
        category = F.when(holds, result).otherwise(category)
    note = F.when(F.col("rule_no") == 6, "On-call senior engineer approval and a retroactive "
                  "review within 48h are required").when(
        F.col("rule_no") == 9, "No rule matched")
    return (
        rows.select("change_id", rule.alias("rule_no"), category.alias("category_id"))
        .withColumn("confidence", F.when(F.col("rule_no") == 9, 0.6).otherwise(0.95))
        .withColumn("note", note)
    )


def with_category(classified: DataFrame) -> DataFrame:
    """Attach path, deadlines, holds and runbook of the category (five fixed rows)."""
    rules = categories(classified.sparkSession)
    return classified.join(F.broadcast(rules), "category_id", "left")


def _hours(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def _from_two_teams() -> Column:
    """Whether two of the people, one of each group of teams, could be picked: a person of both
    groups counts for one of them."""
    one, other = (F.collect_set(F.when(F.col("team").isin(teams), F.col("approver"))) for teams in REVIEW_TEAMS)
    return (F.size(one) > 0) & (F.size(other) > 0) & (F.size(F.array_union(one, other)) > 1)


def readiness(classified: DataFrame, changes: DataFrame, approvals: DataFrame) -> DataFrame:
    """Whether each change may go to production at its ``checked_at``, and what is open.

    ``changes`` say when a change was opened, staged, put on the canary tenant and reviewed
    after deployment; a missing or later time means not yet. The canary hold runs from the
    canary's start, the mandatory wait beside the staging hold. Shared-layer changes need
    reviewers of two teams. A review is overdue while it is open past its deadline.
    ``approvals`` name people, roles and teams; a change has few, so its people are one array.
    """
    people = approvals.select("change_id", "role", "approver", "team").distinct()
    roles = sorted({role for needed in APPROVERS.values() for role in needed})
    counts = people.groupBy("change_id").agg(*[
        F.count_distinct(F.when(F.col("role") == role, F.col("approver"))).alias(f"_{role}") for role in roles])
    teams = people.filter(F.col("role") == "engineer").groupBy("change_id").agg(_from_two_teams().alias("_two_teams"))
    missing = F.lit(0)
    for category, needed in APPROVERS.items():
        open_ = F.lit(0)
        for role, least in needed.items():
            have = F.coalesce(f"_{role}", F.lit(0))
            open_ = open_ + F.greatest(F.lit(least) - have, F.lit(0))
        missing = F.when(F.col("category_id") == category, open_).otherwise(missing)

    rows = (
        with_category(classified.select("change_id", "category_id"))
        .join(changes.select("change_id", "opened_at", "staged_at", "canary_at", "reviewed_at", "checked_at"), "change_id")
        .join(counts, "change_id", "left")
        .join(teams, "change_id", "left")
    )
    now = F.col("checked_at")
    held, on_canary = (F.coalesce(_hours(F.col(at), now), F.lit(-1.0)) for at in ("staged_at", "canary_at"))
    reviewed = F.coalesce(F.col("reviewed_at") <= now, F.lit(False))
    checks = {
        "hold_done": held >= F.col("staging_hold_hours"),
        "canary_done": (F.col("canary_hold_hours") == 0) | (on_canary >= F.col("canary_hold_hours")),
        "wait_done": held >= F.col("mandatory_wait_days") * 24,
        "teams_done": ~F.col("category_id").isin(TWO_TEAM_CATEGORIES) | F.coalesce("_two_teams", F.lit(False)),
    }
    return rows.select(
        "change_id", "category_id", *[check.alias(name) for name, check in checks.items()],
        missing.cast("bigint").alias("approvals_missing"),
        (_hours(F.col("opened_at"), now) > F.col("sla_hours")).alias("sla_breached"),
        (F.coalesce(held > F.col("retroactive_review_hours"), F.lit(False)) & ~reviewed).alias("review_overdue"),
    ).withColumn("ready", F.expr(" AND ".join(checks)) & (F.col("approvals_missing") == 0))


def _near(rows: DataFrame, deployments: DataFrame, span: Column) -> DataFrame:
    """Rows that arrived in some deployment's span: two times read once, so that the scan is
    bounded before the join."""
    first, last = deployments.agg(F.min(F.col("deployed_at") - span), F.max(F.col("deployed_at") + span)).first()
    arrived = F.col("_ingested_at")
    rows = rows.filter(F.lit(False)) if first is None else rows.filter((arrived >= F.lit(first)) & (arrived < F.lit(last)))
    if first is not None and "ingest_week" in rows.columns:
        week = F.col("ingest_week")
        rows = rows.filter((week >= F.to_date(F.date_trunc("week", F.lit(first)))) & (week <= F.to_date(F.lit(last))))
    return rows


def window_metrics(
    rows: DataFrame, deployments: DataFrame, hours: Column, missing: Column, unexpected: Column,
) -> DataFrame:
    """Volume and quality after each deployment against the same time span before it.

    ``rows`` carry tenant_id and _ingested_at; deployments are one row per tenant.
    """
    at, seen = F.col("deployed_at"), F.col("_ingested_at")
    span = F.make_dt_interval(hours=hours)
    after = (seen >= at) & (seen < at + span)
    before = (seen >= at - span) & (seen < at)
    counted = _near(rows, deployments, span).join(deployments, "tenant_id").groupBy("tenant_id", "category_id").agg(
        F.count_if(before).alias("rows_before"), F.count_if(after).alias("rows_after"),
        F.count_if(after & missing).alias("missing_after"),
        F.count_if(after & unexpected).alias("unexpected_after"),
    )
    n = F.col("rows_after")
    return counted.select(
        "tenant_id", "category_id", "rows_before", "rows_after",
        pct(F.col("missing_after"), n, 2).alias("null_rate_pct"),
        pct(F.col("unexpected_after"), n, 2).alias("unexpected_pct"),
        F.round(change_pct(n.cast("double"), F.col("rows_before").cast("double")), 2)
        .alias("row_count_delta_pct"),
    )


def schema_drift(bronze: DataFrame, deployments: DataFrame, hours: Column) -> DataFrame:
    """Whether a tenant's schema deviates after its deployment otherwise than before (V01).

    The same spans as in ``window_metrics``; without events on both sides nothing is known
    and there is no row. One row per tenant leaves the map side for each field.
    """
    at, seen = F.col("deployed_at"), F.col("_ingested_at")
    span = F.make_dt_interval(hours=hours)
    after = (seen >= at) & (seen < at + span)
    near = after | ((seen >= at - span) & (seen < at))
    rows = _near(bronze, deployments, span).join(deployments, "tenant_id").filter(near).select(
        F.struct("tenant_id", after.alias("after")).alias("tenant_id"), "payload")
    side, tenant = F.col("tenant_id.after"), F.col("tenant_id.tenant_id").alias("tenant_id")
    seen_on = rows.groupBy(tenant).agg(
        F.bool_or(side).alias("_after"), F.bool_or(~side).alias("_before")).filter("_after AND _before")
    row = F.struct("field", "kind", "actual")
    known = deviations(source_fields(rows)).groupBy(tenant).agg(
        F.sort_array(F.collect_set(F.when(side, row))).alias("_now"),
        F.sort_array(F.collect_set(F.when(~side, row))).alias("_then"))
    return seen_on.join(known, "tenant_id", "left").select(
        "tenant_id", (~F.col("_now").eqNullSafe(F.col("_then"))).alias("schema_drift"))


def rollback_recommendations(metrics: DataFrame, drift: Column) -> DataFrame:
    """Breached limits per tenant; people decide, this only recommends."""
    rows = with_category(metrics)
    reasons = F.array_compact(F.array(
        F.when(F.col("unexpected_pct") > F.col("dq_failure_limit_pct"), "dq_failure_rate"),
        F.when(F.abs("row_count_delta_pct") > F.col("row_delta_limit_pct"), "row_count_delta"),
        F.when(F.col("drift_blocks") & drift, "schema_drift"),
    ))
    return rows.select(
        "tenant_id", "category_id", "unexpected_pct", "row_count_delta_pct",
        reasons.alias("reasons"), "rollback_runbook",
    ).withColumn("recommend_rollback", F.size("reasons") > 0)


def canary_verdict(metrics: DataFrame) -> DataFrame:
    """Hold result of a canary tenant under the stricter limits."""
    reasons = F.array_compact(F.array(*[
        F.when(F.abs(F.col(name)) > limit, name) for name, limit in CANARY_LIMITS.items()]))
    return metrics.select("tenant_id", *CANARY_LIMITS, reasons.alias("reasons")).withColumn(
        "verdict", F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL"))


def typical_tenants(registry: DataFrame, volumes: DataFrame) -> DataFrame:
    """Active tenants whose volume is near the median of all.

    ``volumes`` is one row per tenant; the median is selected from their counts.
    """
    counts = volumes.groupBy(F.col("volume").cast("double").alias("volume")).agg(F.count(F.lit(1)).alias("n"))
    median = weighted_median(counts, (), "volume", "n", "median")
    near = F.abs(F.col("volume") - F.col("median")) * 100 <= F.col("median") * CANARY_VOLUME_PCT
    return (
        registry.filter(F.col("state") == "ACTIVE").select("tenant_id")
        .join(volumes, "tenant_id")
        .withColumn("median", median.scalar())
        .filter(near)
    )


def canary_candidates(typical: DataFrame, deviating: DataFrame) -> DataFrame:
    """Typical tenants without schema deviation; only those have to be looked at for one."""
    return typical.join(deviating.select("tenant_id"), "tenant_id", "left_anti")


def staging_comparison(
    staging: DataFrame, baseline: DataFrame, keys: Sequence[str], quality: DataFrame,
    max_delta_pct: float = 10.0, min_pass_pct: float = 100.0,
) -> DataFrame:
    """Row and schema differences of two versions of a table, with a verdict per tenant.

    ``quality`` holds tenant_id and pass_rate_pct. Column names and types are compared
    from metadata; rows by key and all other columns, where NULL equals NULL only.
    Columns whose types differ or cannot be compared are compared as text.
    """
    types, before = dict(staging.dtypes), dict(baseline.dtypes)
    drift = types != before
    shared = [c for c in baseline.columns if c in types and c not in keys]
    direct = {c for c in shared if types[c] == before[c] and "map<" not in types[c] and "variant" not in types[c]}

    def side(df: DataFrame, name: str) -> DataFrame:
        values = [F.col(c) if c in direct else F.col(c).cast("string") for c in shared]
        return df.select(*keys, F.struct(F.lit(True).alias("_in"), *(
            v.alias(f"v{i}") for i, v in enumerate(values))).alias(name))

    joined = side(baseline, "_b").join(side(staging, "_s"), list(keys), "full_outer")
    b, s = F.col("_b"), F.col("_s")
    counted = joined.groupBy("tenant_id").agg(
        F.count(b).alias("baseline_rows"), F.count(s).alias("staging_rows"),
        F.count_if(b.isNull()).alias("added"), F.count_if(s.isNull()).alias("removed"),
        F.count_if(b.isNotNull() & s.isNotNull() & ~b.eqNullSafe(s)).alias("changed"),
    )
    delta = F.round(change_pct(
        F.col("staging_rows").cast("double"), F.col("baseline_rows").cast("double")), 2)
    rows = counted.join(quality, "tenant_id", "left").withColumn("row_count_delta_pct", delta)
    issues = F.array_compact(F.array(
        F.when(F.lit(drift), "schema_drift"),
        F.when(F.coalesce(F.abs("row_count_delta_pct") > max_delta_pct, F.lit(True)),
               "row_count_delta"),
        F.when(F.coalesce(F.col("pass_rate_pct") < min_pass_pct, F.lit(True)), "dq_pass_rate"),
    ))
    return rows.withColumn("schema_drift", F.lit(drift)).withColumn("issues", issues).withColumn(
        "recommendation", F.when(F.size("issues") > 0, "BLOCK").otherwise("PROMOTE"))


def schema_differences(staging: DataFrame, baseline: DataFrame) -> DataFrame:
    """Columns that only one side has or whose types differ (metadata only)."""
    spark = staging.sparkSession
    a = spark.createDataFrame(staging.dtypes, "column_name string, staging_type string")
    b = spark.createDataFrame(baseline.dtypes, "column_name string, baseline_type string")
    return a.join(b, "column_name", "full_outer").filter(
        ~F.col("staging_type").eqNullSafe(F.col("baseline_type")))
