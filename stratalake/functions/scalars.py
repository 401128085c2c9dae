"""Column expressions shared by all layers. Everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.schemas import PAYLOAD_FIELDS

NULL_MARK = "<null>"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def payload_struct(payload: Column | str = "payload", fields=tuple(PAYLOAD_FIELDS)) -> Column:
    """All wanted payload fields as text from one parse of the JSON document."""
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    return F.from_json(column(payload), schema)


def json_text(payload: Column | str, field: str) -> Column:
    """One payload field as text; NULL when absent or the document is malformed."""
    return F.get_json_object(column(payload), f"$.{field}")


def pct(part: Column, whole: Column, digits: int) -> Column:
    """Share in percent, rounded half up; NULL when the whole is zero."""
    return F.round(part * F.lit(100.0) / F.nullif(whole, F.lit(0)), digits)


def ratio(part: Column, whole: Column, digits: int) -> Column:
    return F.round(part * F.lit(1.0) / F.nullif(whole, F.lit(0)), digits)


def on_or_after(ts: Column | str, as_of, days: int) -> Column:
    """Look-back filter. The window starts at midnight because it is cut at a date."""
    return column(ts) >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")


def week_start(ts: Column | str) -> Column:
    return F.date_trunc("week", column(ts)).cast("date")


def cycle_hours(days: Column) -> Column:
    return (days * F.lit(24.0)).cast("double")


def hash_key(*keys: Column | str) -> Column:
    """Hub or link key: SHA-256 over the upper-cased, trimmed business keys.

    A single key is hashed as it is, several in a form that keeps them apart.
    """
    parts = [F.upper(F.trim(column(k))) for k in keys]
    return F.sha2(parts[0] if len(parts) == 1 else apart(*parts), 256)


def hash_diff(*attributes: Column | str) -> Column:
    """Fingerprint of a satellite row; NULL differs from every text, order matters."""
    return F.sha2(apart(*[column(a).cast("string") for a in attributes]), 256)


def apart(*parts: Column) -> Column:
    """Texts in one, each behind its length, so that no two lists of texts are alike."""
    return F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit(NULL_MARK))
                      for p in parts])


def safe_id(tenant_id: Column | str) -> Column:
    """Tenant id in a form usable inside object names; data keeps the original."""
    return F.translate(column(tenant_id), "-", "_")


def dashboard_id(tenant_id: Column | str, template: Column | str) -> Column:
    return F.concat_ws(":", F.lit("native"), column(tenant_id), column(template))


def contract_path(tenant_id: Column | str, layer: Column | str) -> Column:
    return F.format_string("dq/expectations/%s/%s_contract.yml", column(tenant_id), column(layer))


def layer_of_path(path: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(column(path), r"([^/]+)\.[^./]*$", 1), "_contract", "")


def alert_channel(tenant_id: Column | str, prefix: str = "#") -> Column:
    return F.concat(F.lit(f"{prefix}dq-"), column(tenant_id))


def updates_channel(tenant_id: Column | str, prefix: str = "#") -> Column:
    return F.concat(F.lit(f"{prefix}tenant-"), column(tenant_id), F.lit("-updates"))


def change_line(ts: Column | str, component: Column | str, description: Column | str) -> Column:
    return F.format_string(
        "- %s: [%s] %s",
        F.coalesce(F.date_format(column(ts), "yyyy-MM-dd HH:mm:ss"), F.lit("unknown time")),
        F.coalesce(column(component), F.lit("unknown component")),
        F.coalesce(column(description), F.lit("")),
    )


def alert_text(severity, tenant_id, layer, metric, current, baseline, delta, description) -> Column:
    """Channel message of one alert, with severity marker and signed percentage."""
    marker = F.when(column(severity) == "sev1", ":rotating_light:").otherwise(":warning:")
    return F.format_string(
        "%s %s alert for %s\n%s %s is %.2f, usually %.2f (%+.1f%%)\n%s",
        marker, F.upper(column(severity)), column(tenant_id), column(layer), column(metric),
        column(current), column(baseline), column(delta), column(description),
    )


def outcome(approved: Column, rejected: Column, escalated: Column) -> Column:
    return (
        F.when(approved == 1, "approved")
        .when(rejected == 1, "rejected")
        .when(escalated == 1, "escalated")
        .otherwise("in_progress")
    )


def schema_purpose(schema_name: Column | str) -> Column:
    """Label of a schema. In LIKE the underscore stands for any one character."""
    name = column(schema_name)
    return (
        F.when(name.like("gold_%"), "per-tenant Gold")
        .when(name == "monitoring", "platform monitoring")
        .otherwise(name)
    )
