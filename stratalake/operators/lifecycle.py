"""Tenant bookkeeping as table jobs: registry, dashboards, contracts, rollbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.functions.scalars import contract_path, dashboard_id
from stratalake.operators.upsert import insert_absent, update_where, upsert
from stratalake.schemas import CONTRACT_LAYERS, DASHBOARD_TEMPLATES


def per_tenant(tenants: DataFrame, name: str, values: list[str]) -> DataFrame:
    """Every tenant with every entry of a fixed list; narrow, without a join."""
    return tenants.select("tenant_id", F.explode(F.array(*map(F.lit, values))).alias(name))


def register(registry: DataFrame, tenants: DataFrame, at: Column, env: Column) -> DataFrame:
    """Registry after registration: unknown tenants start as PENDING, known ones stay."""
    nothing = F.lit(None)
    rows = tenants.select(
        "tenant_id", F.col("tenant_id").alias("display_name"), env.alias("env"),
        F.lit("PENDING").alias("state"), at.alias("created_at"),
        nothing.cast("timestamp").alias("activated_at"),
        nothing.cast("timestamp").alias("deactivated_at"),
        nothing.cast("string").alias("deactivation_reason"),
    )
    return registry.unionByName(insert_absent(registry, rows, ["tenant_id"]))


def activate(registry: DataFrame, ready: DataFrame) -> DataFrame:
    """Registered tenants named in ``ready(tenant_id, activated_at)`` become ACTIVE."""
    return upsert(registry, ready, ["tenant_id"], update={
        "state": F.lit("ACTIVE"), "activated_at": F.col("s.activated_at"),
    })


def deactivate(registry: DataFrame, condition: Column, at: Column, reason: Column) -> DataFrame:
    return update_where(registry, condition, {
        "state": F.lit("ROLLBACK"), "deactivated_at": at, "deactivation_reason": reason,
    })


def deactivate_contracts(contracts: DataFrame, tenants: DataFrame) -> DataFrame:
    return upsert(contracts, tenants.select("tenant_id").distinct(), ["tenant_id"],
                  update={"is_active": F.lit(False)})


def dashboard_rows(
    tenants: DataFrame, at: Column, env: Column, templates: list[str] = DASHBOARD_TEMPLATES
) -> DataFrame:
    return per_tenant(tenants, "template_name", templates).select(
        "tenant_id", "template_name",
        dashboard_id("tenant_id", "template_name").alias("dashboard_id"),
        env.alias("env"), at.alias("registered_at"), F.lit("native").alias("dashboard_type"),
    )


def register_dashboards(dashboards: DataFrame, rows: DataFrame) -> DataFrame:
    return upsert(
        dashboards, rows, ["tenant_id", "template_name"],
        update={"dashboard_id": F.col("s.dashboard_id"),
                "registered_at": F.col("s.registered_at")},
        insert={},
    )


def contract_rows(
    tenants: DataFrame, at: Column, layers: list[str] = CONTRACT_LAYERS
) -> DataFrame:
    return per_tenant(tenants, "layer", layers).select(
        "tenant_id", "layer", contract_path("tenant_id", "layer").alias("contract_path"),
        at.alias("created_at"), F.lit(True).alias("is_active"),
    )


def register_contracts(contracts: DataFrame, rows: DataFrame) -> DataFrame:
    return contracts.unionByName(insert_absent(contracts, rows, ["tenant_id", "layer"]))
