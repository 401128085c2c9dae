"""Schema deviation per tenant and the Silver projection that adapts to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake import schemas as S
from stratalake.functions.scalars import payload_struct

TOP_LEVEL = {"event_id": "STRING", "event_type": "STRING", "event_timestamp": "TIMESTAMP",
             "source_system": "STRING"}
CASTS = {"BIGINT": "bigint", "DOUBLE": "double", "DATE": "date", "TIMESTAMP": "timestamp",
         "STRING": "string"}
TYPED = [k for k in CASTS if k != "STRING"]


def _all_are(kind: str) -> Column:
    text = F.col("text")
    casted = F.expr(f"try_cast(text AS {CASTS[kind]})").isNotNull()
    if kind == "DATE":  # a cast to date also accepts a time behind the day
        casted = casted & text.rlike(r"^\d{4}-\d{2}-\d{2}$")
    if kind == "TIMESTAMP":  # and a cast to timestamp accepts a bare year
        casted = casted & text.rlike(r"^\d{4}-\d{2}-\d{2}[ T]")
    return F.bool_and(casted).alias(kind)


def field_profile(bronze: DataFrame) -> DataFrame:
    """A row per tenant and payload field: for each type, whether all its values support it.

    Payload keys are read from the documents; a tenant, field and type need not be known
    beforehand, and one row per tenant and field leaves the map side. A tenant's rows
    without any field give one row with a NULL field. The flags only ever turn from true to
    false, so profiles of parts merge into that of the whole (``merged_profile``).
    """
    keyed = bronze.select(
        "tenant_id", F.explode_outer(F.from_json("payload", "map<string,string>")).alias("field", "text"))
    field = F.when(F.col("text").isNotNull(), F.col("field")).alias("field")
    return keyed.groupBy("tenant_id", field).agg(*[_all_are(k) for k in TYPED])


def merged_profile(profiles: DataFrame) -> DataFrame:
    """The profile of all parts, whatever their number and order."""
    return profiles.groupBy("tenant_id", "field").agg(*[F.bool_and(k).alias(k) for k in TYPED])


def source_fields(bronze: DataFrame) -> DataFrame:
    """Fields each tenant really sends, with the most precise type all values support."""
    return profile_fields(field_profile(bronze))


def profile_fields(profile: DataFrame) -> DataFrame:
    """The same from a stored profile, without reading a payload."""
    precise = reduce(
        lambda rest, kind: F.when(F.col(kind), kind).otherwise(rest), reversed(TYPED),
        F.lit("STRING"),
    )
    sent = profile.filter(F.col("field").isNotNull()).select("tenant_id", "field", precise.alias("type"))
    columns = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(t).alias("type")) for f, t in TOP_LEVEL.items()
    ])
    tenants = profile.select("tenant_id").distinct()
    return sent.unionByName(tenants.select("tenant_id", F.inline(columns)))


def deviations(fields: DataFrame, platform_fields: bool = False) -> DataFrame:
    """Rows (tenant, field, kind, expected, actual) for extra, missing and mistyped fields.

    Columns the platform itself adds never count as missing unless ``platform_fields``.
    """
    standard = [f for f in S.STANDARD_FIELDS if platform_fields or f not in S.PLATFORM_FIELDS]
    types = F.create_map(*[F.lit(x) for pair in S.EXPECTED_TYPES.items() for x in pair])
    known = F.array(*map(F.lit, S.STANDARD_FIELDS))
    nothing = F.lit(None).cast("string")

    def row(field: Column, kind: str, expected: Column, actual: Column) -> Column:
        return F.struct(field.alias("field"), F.lit(kind).alias("kind"),
                        expected.alias("expected"), actual.alias("actual"))

    # A tenant's fields are a set of schema width, so they are compared as one array.
    actual = F.upper(F.coalesce("type", F.lit("UNKNOWN")))
    sent = fields.groupBy("tenant_id").agg(
        F.collect_set(F.struct("field", actual.alias("actual"))).alias("_sent"))
    extra = F.transform(
        F.filter("_sent", lambda f: ~F.array_contains(known, f["field"])),
        lambda f: row(f["field"], "extra", nothing, f["actual"]))
    mistyped = F.transform(
        F.filter("_sent", lambda f: f["actual"] != types[f["field"]]),
        lambda f: row(f["field"], "type_mismatch", types[f["field"]], f["actual"]))
    missing = F.transform(
        F.array_except(F.array(*map(F.lit, standard)), F.col("_sent.field")),
        lambda name: row(name, "missing", types[name], nothing))
    return sent.select("tenant_id", F.inline(F.concat(extra, missing, mistyped)))


def reports(deviation_rows: DataFrame) -> DataFrame:
    """One row per deviating tenant with sorted lists."""
    def names(kind: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("field"))))

    return deviation_rows.groupBy("tenant_id").agg(
        names("extra").alias("extra_fields"), names("missing").alias("missing_fields"),
        names("type_mismatch").alias("type_mismatches"))


def deviation_flags(tenants: DataFrame, deviation_rows: DataFrame) -> DataFrame:
    found = deviation_rows.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("deviations"))
    n = F.coalesce("deviations", F.lit(0))
    return tenants.select("tenant_id").distinct().join(found, "tenant_id", "left").select(
        "tenant_id", n.alias("deviations"), (n > 0).alias("has_deviation"))


def adapted_silver(bronze: DataFrame, deviation_rows: DataFrame, run_ts: Column | None = None) -> DataFrame:
    """All standard columns, and the tenant's extra fields as a map of typed values.

    ``extras`` holds each extra field that the event sends, as a variant of the most precise
    type that tenant's values support, whatever other tenants send under the same name. The
    types stay in Spark, as one row of schema width per tenant.
    """
    stamp = F.current_timestamp() if run_ts is None else run_ts
    types = deviation_rows.filter(F.col("kind") == "extra").groupBy("tenant_id").agg(
        F.map_from_entries(F.collect_set(F.struct("field", "actual"))).alias("_types"))
    doc = bronze.withColumn("_doc", F.from_json("payload", "map<string,string>")).join(
        types, "tenant_id", "left")
    typed = "CASE _types[f] " + " ".join(
        f"WHEN '{kind}' THEN CAST(try_cast(t AS {cast}) AS VARIANT)" for kind, cast in CASTS.items()
    ) + " END"
    extras = F.expr(
        f"transform_values(map_filter(_doc, (f, t) -> map_contains_key(_types, f)), (f, t) -> {typed})")
    return doc.select(
        "tenant_id", "event_id", "event_type",
        F.col("event_timestamp").try_cast("timestamp").alias("event_timestamp"), "source_system",
        F.col("_doc")["status"].alias("status"), F.col("_doc")["reference_id"].alias("reference_id"),
        stamp.alias("created_at"), stamp.alias("last_updated_at"), extras.alias("extras"),
        "_ingested_at", "_batch_id",
    )


def custom_states(silver: DataFrame) -> DataFrame:
    """Statuses outside the contract's set, kept as they are and proposed for it."""
    return silver.filter(
        F.col("status").isNotNull() & ~F.col("status").isin(S.CONTRACT_STATUSES)
    ).groupBy("tenant_id", "status").agg(F.count(F.lit(1)).alias("events"))
