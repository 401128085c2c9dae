"""Data Vault loads: hub, link and the history-keeping satellite."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalake.functions.scalars import hash_diff, hash_key
from stratalake.functions.skew import PART, TIE, heavy_cuts, in_parts
from stratalake.operators.upsert import insert_absent
from stratalake.session import new_path

RECORD_SOURCE = "silver.events"
SATELLITE_ATTRIBUTES = ("status", "reference_id", "event_type")


def hub_rows(silver: DataFrame) -> DataFrame:
    """One row per hashed business key; ids equal after trim and upper case share it."""
    return (
        silver.groupBy("tenant_id", hash_key("event_id").alias("h_event_hk"))
        .agg(F.min("event_id").alias("event_id"), F.min("event_timestamp").alias("load_dts"))
        .select("h_event_hk", "tenant_id", "event_id", "load_dts",
                F.lit(RECORD_SOURCE).alias("record_source"))
    )


def hub_load(hub: DataFrame, silver: DataFrame) -> DataFrame:
    """New hub rows to append; known keys are never touched."""
    return insert_absent(hub, hub_rows(silver), ("h_event_hk", "tenant_id"))


def link_rows(silver: DataFrame) -> DataFrame:
    """Event-to-reference link keyed by the hash of both hub keys."""
    return (
        silver.filter(F.col("reference_id").isNotNull())
        .groupBy("tenant_id", "event_id", "reference_id")
        .agg(F.min("event_timestamp").alias("load_dts"))
        .select(
            hash_key("event_id", "reference_id").alias("l_event_reference_hk"),
            "tenant_id",
            hash_key("event_id").alias("h_event_hk"),
            hash_key("reference_id").alias("h_reference_hk"),
            "load_dts",
            F.lit(RECORD_SOURCE).alias("record_source"),
        )
    )


def link_load(link: DataFrame, silver: DataFrame) -> DataFrame:
    return insert_absent(link, link_rows(silver), ("l_event_reference_hk", "tenant_id"))


SATELLITE_KEYS = ("tenant_id", "h_event_hk")


def satellite_versions(versions: DataFrame) -> DataFrame:
    """Hashed key and fingerprint of every version of every event."""
    return versions.select(
        "tenant_id", hash_key("event_id").alias("h_event_hk"), "_ingested_at", "_batch_id",
        *SATELLITE_ATTRIBUTES, hash_diff(*SATELLITE_ATTRIBUTES).alias("hash_diff"),
    )


VERSION_ORDER = ("_ingested_at", "_batch_id", "hash_diff")


HASHES = ("h_event_hk", "hash_diff")


def _packed(rows: DataFrame) -> DataFrame:
    """Hashes as bytes, half as long as their digits; other texts behind another first byte."""
    def packed(c: str):
        digits = F.unhex(c)
        plain = F.concat(F.lit(b"\0"), F.col(c).cast("binary"))
        return F.when(F.lower(F.hex(digits)) == F.col(c), F.concat(F.lit(b"\1"), digits)).otherwise(plain)

    return rows.withColumns({c: packed(c) for c in HASHES if c in rows.columns})


def _unpacked(rows: DataFrame) -> DataFrame:
    def plain(c: str):
        rest = F.substring(c, 2, 1 << 30)
        return F.when(F.substring(c, 1, 1) == F.lit(b"\1"), F.lower(F.hex(rest))).otherwise(rest.cast("string"))

    return rows.withColumns({c: plain(c) for c in HASHES if c in rows.columns})


def satellite_history(hashed: DataFrame) -> DataFrame:
    """Satellite rows of the given versions (see satellite_versions).

    A version counts when its fingerprint differs from the one before; it ends where
    the next counted version starts.
    """
    packed = _packed(hashed)
    return _unpacked(_history(packed, heavy_cuts(packed, SATELLITE_KEYS, VERSION_ORDER)))


def _history(versions: DataFrame, cuts: dict[int, list]) -> DataFrame:
    """Satellite rows, hashes packed. One shuffle by key gives the counted versions of each
    part of a key and their ends; parts of cut keys are then joined at their borders."""
    keys = [*SATELLITE_KEYS]
    rows = in_parts(versions, keys, VERSION_ORDER, cuts) if cuts else versions
    inside = Window.partitionBy(*keys, *([PART] if cuts else [])).orderBy(*VERSION_ORDER, *([TIE] if cuts else []))
    before = F.lag(F.struct("hash_diff")).over(inside)
    starts = rows.withColumn("_before", before).filter(
        F.col("_before").isNull() | (F.col("_before.hash_diff") != F.col("hash_diff"))).drop("_before")
    closed = starts.withColumn("_after", F.lead(F.struct(F.col("_ingested_at").alias("at"))).over(inside))
    if cuts:
        closed = _bordered(closed)
    return closed.select(
        "h_event_hk", F.col("_ingested_at").alias("load_dts"),
        F.col("_after.at").alias("load_end_dts"), "tenant_id", "hash_diff",
        *SATELLITE_ATTRIBUTES, F.lit(RECORD_SOURCE).alias("record_source"),
    )


def _bordered(starts: DataFrame) -> DataFrame:
    """Counted versions of parts, written, with those left out that repeat the end of the part
    before, and with ends that lie in later parts. One row per part of a cut key is sent to all."""
    spark, path = starts.sparkSession, new_path(starts.sparkSession, "satellite_parts")
    starts.write.parquet(path)
    rows = spark.read.schema(starts.schema).parquet(path)
    keys = [*SATELLITE_KEYS]
    place = F.struct(*VERSION_ORDER, TIE)
    edges = rows.filter(F.col(PART) > 0).groupBy(*keys, PART).agg(
        F.min_by(F.struct("hash_diff", F.struct(F.col("_ingested_at").alias("at")).alias("start"), "_after", TIE), place).alias("first"),
        F.max_by("hash_diff", place).alias("last"))
    parts = Window.partitionBy(*keys).orderBy(PART)
    repeats = F.coalesce(F.lag("last").over(parts) == F.col("first.hash_diff"), F.lit(False))
    later = Window.partitionBy(*keys).orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        edges.withColumn("_repeats", repeats)
        .withColumn("_start", F.when(F.col("_repeats"), F.col("first._after")).otherwise(F.col("first.start")))
        .select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(PART).alias("_p"),
                F.when(F.col("_repeats"), F.col(f"first.{TIE}")).alias("_left_out"), F.last("_start", True).over(later).alias("_beyond"))
    )
    on = F.col(PART) == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = rows.join(F.broadcast(borders), on, "left").filter(~F.col(TIE).eqNullSafe(F.col("_left_out")))
    return joined.withColumn("_after", F.coalesce("_after", "_beyond"))


def satellite_append(satellite: DataFrame, batch: DataFrame) -> DataFrame:
    """Satellite after a batch that arrived in order, without reading older versions.

    Reading by watermark gives such batches: every version in it is newer than all
    before. Closed rows pass through unshuffled; open rows of the touched keys become the
    first version of the continued history.
    """
    new = _packed(batch)
    touched = new.select(*SATELLITE_KEYS).distinct()
    is_open = F.col("load_end_dts").isNull()
    opened = _packed(satellite.filter(is_open))
    continued = opened.join(touched, list(SATELLITE_KEYS), "left_semi")
    untouched = opened.join(touched, list(SATELLITE_KEYS), "left_anti")
    last = continued.select(
        *SATELLITE_KEYS, F.col("load_dts").alias("_ingested_at"), F.lit("").alias("_batch_id"),
        *SATELLITE_ATTRIBUTES, "hash_diff",
    )
    fresh = _history(last.unionByName(new), heavy_cuts(new, SATELLITE_KEYS, VERSION_ORDER))
    return (
        satellite.filter(~is_open)
        .unionByName(_unpacked(untouched).select(*satellite.columns))
        .unionByName(_unpacked(fresh).select(*satellite.columns))
    )


def satellite_reload(satellite: DataFrame, hashed: DataFrame, touched: DataFrame) -> DataFrame:
    """Satellite after versions that arrived late: touched keys are rebuilt from all
    their versions, because a late one can revive versions that did not count before.

    The versions of touched keys lie by key after the join, where their history needs them.
    """
    versions = _packed(hashed)
    keys = _packed(touched.select(*SATELLITE_KEYS)).distinct()
    kept = _packed(satellite).join(keys, list(SATELLITE_KEYS), "left_anti")
    affected = versions.join(keys, list(SATELLITE_KEYS), "left_semi")
    fresh = _history(affected, heavy_cuts(versions, SATELLITE_KEYS, VERSION_ORDER))
    return _unpacked(kept).select(*satellite.columns).unionByName(_unpacked(fresh).select(*satellite.columns))
