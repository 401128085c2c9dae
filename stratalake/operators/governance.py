"""Row filters, grants, lifecycle checks and activation gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.functions.scalars import safe_id
from stratalake.functions.skew import in_order, neighbour, newest

# Privilege, object kind, object name and principal; {t} is the safe tenant id.
GRANT_MATRIX = [
    ("READ_METADATA", "SCHEMA", "bronze", "sp-tenant-{t}"),
    ("READ_METADATA", "SCHEMA", "silver", "sp-tenant-{t}"),
    ("ALL PRIVILEGES", "SCHEMA", "gold_{t}", "sp-tenant-{t}"),
    ("SELECT", "SCHEMA", "gold_{t}", "analysts_{t}"),
    ("SELECT", "SCHEMA", "feature_store", "sp-tenant-{t}"),
    ("SELECT", "TABLE", "monitoring.tenant_change_log", "sp-tenant-{t}"),
]


def visible_rows(df: DataFrame, entitlements: DataFrame, principal: str) -> DataFrame:
    """Rows a principal may see. Entitlements are (principal, tenant_id) rows.

    With the table partitioned by tenant, Spark prunes the other tenants' files.
    """
    mine = entitlements.filter(F.col("principal") == principal).select("tenant_id")
    return df.join(mine, "tenant_id", "left_semi")


def isolation_violations(seen: DataFrame, entitlements: DataFrame) -> DataFrame:
    """Rows seen by principals without the right to; rows are counted before the join."""
    counted = seen.groupBy("principal", "tenant_id").agg(F.count(F.lit(1)).alias("leaked_rows"))
    return counted.join(entitlements, ["principal", "tenant_id"], "left_anti")


def grant_rows(tenants: DataFrame, catalog: str) -> DataFrame:
    """One row per tenant and rule, with the statement an administrator would run."""
    rules = F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(
            ("privilege", "object_type", "object_tpl", "principal_tpl"), rule)])
        for rule in GRANT_MATRIX
    ])
    rows = tenants.select("tenant_id", F.inline(rules)).withColumn("_t", safe_id("tenant_id"))
    fill = [F.replace(F.col(c), F.lit("{t}"), F.col("_t")) for c in ("object_tpl", "principal_tpl")]
    rows = rows.select("tenant_id", "privilege", "object_type", fill[0].alias("object_name"),
                       fill[1].alias("principal"))
    statement = F.format_string(
        f"GRANT %s ON %s {catalog}.%s TO `%s`", "privilege", "object_type", "object_name",
        "principal")
    return rows.withColumn("statement", statement)


def grant_outcome(grants: DataFrame, principals: DataFrame) -> DataFrame:
    """Split into applied and skipped: a principal that does not exist yet is skipped."""
    known = principals.select("principal").distinct().withColumn("_known", F.lit(True))
    return grants.join(known, "principal", "left").withColumn(
        "outcome", F.when(F.col("_known"), "applied").otherwise("skipped")).drop("_known")


def grant_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("tenant_id").agg(
        F.count_if(F.col("outcome") == "applied").alias("applied"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
    ).withColumn("description", F.format_string("%d applied, %d skipped", "applied", "skipped"))


def changes_after(history: DataFrame, ts: str, after: Column) -> DataFrame:
    return history.filter(F.col(ts) > after)


def previous_state(history: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The newest entry of each key that is no longer current."""
    return newest(history.filter(~F.col("is_current")), keys, order)


def transitions(log: DataFrame) -> DataFrame:
    """Each state change with the state before it and whether the step is allowed."""
    legal = F.lit(False)
    for here, there in zip(S.STATES, S.STATES[1:]):
        legal = legal | (
            (F.col("from_state") == here) & F.col("to_state").isin(there, S.FAILED))
    ordered = in_order(log, ["tenant_id"], ["changed_at", "seq"])
    steps = neighbour(ordered, ["tenant_id"], F.col("state"), "_p", -1)
    return (
        steps.filter(F.col("_p").isNotNull())
        .select("tenant_id", "changed_at", "seq", F.col("_p.v").alias("from_state"),
                F.col("state").alias("to_state"))
        .withColumn("legal", legal)
    )


def current_states(log: DataFrame) -> DataFrame:
    """Newest state of each tenant with the next one on the regular path."""
    state = F.max_by("state", F.struct("changed_at", "seq"))
    following = F.create_map(*[
        F.lit(x) for pair in zip(S.STATES, S.STATES[1:]) for x in pair])
    return log.groupBy("tenant_id").agg(state.alias("state")).select(
        "tenant_id", "state", following[F.col("state")].alias("next_state"),
        F.col("state").isin(S.STATES[-1], S.FAILED).alias("is_terminal"))


def activation_gate(
    tenants: DataFrame, schemas: DataFrame, contracts: DataFrame, alerts: DataFrame | None = None
) -> DataFrame:
    """Tenants that may be activated: Gold schema present, an active contract, and, when
    the alert table is given, no unresolved alert."""
    gold = schemas.select("schema_name").distinct().withColumn("has_gold", F.lit(True))
    active = contracts.filter("is_active").groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("active_contracts"))
    rows = (
        tenants.select("tenant_id", F.concat(F.lit("gold_"), safe_id("tenant_id"))
                       .alias("schema_name"))
        .join(gold, "schema_name", "left").join(active, "tenant_id", "left")
    )
    has_gold = F.coalesce("has_gold", F.lit(False))
    n = F.coalesce("active_contracts", F.lit(0))
    reason = F.when(~has_gold, "gold schema missing").when(n == 0, "no active contract")
    if alerts is not None:
        unresolved = alerts.filter(~F.col("resolved")).select("tenant_id").distinct()
        rows = rows.join(unresolved.withColumn("_open", F.lit(True)), "tenant_id", "left")
        reason = reason.when(F.col("_open"), "unresolved alert")
    return rows.select(
        "tenant_id", has_gold.alias("has_gold"), n.alias("active_contracts"),
        reason.isNull().alias("can_activate"), reason.alias("reason"))
