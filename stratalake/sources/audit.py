"""Rows for the change log, written for many tenants at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit_rows(
    tenants: DataFrame, at: Column, change_type: str, component: str,
    description: Column | str, env: Column,
) -> DataFrame:
    text = F.lit(description) if isinstance(description, str) else description
    nothing = F.lit(None).cast("string")
    return tenants.select(
        "tenant_id", at.alias("change_timestamp"), F.lit(change_type).alias("change_type"),
        F.lit(component).alias("component"), text.alias("description"),
        nothing.alias("changed_by"), nothing.alias("pr_url"), env.alias("env"),
    )
